"""Personal values with digits beside them, Luhn-valid short numbers and long secrets."""

import random

import pytest

from sourceweave.llm import feistel


@pytest.mark.parametrize("text,value", [
    ("4111111111111111 123", "4111111111111111"), ("4111 1111 1111 1111 12/27", "4111 1111 1111 1111"), ("4111111111111111 5 items", "4111111111111111"),
    ("order 12 4111111111111111", "4111111111111111"), ("1 4111111111111111 123 77", "4111111111111111"), ("4111111111111111 2024-02-29", "2024-02-29"),
    ("4111111111111111 10.0.0.1", "10.0.0.1"), ("411111 1111111111 123", "411111 1111111111"), ("4111111111111111 4012888888881881", "4012888888881881")])
def test_card_beside_digits(text, value):
    new, found = feistel.pseudonymise(text)
    assert value not in new and found["card"] >= 1
    assert feistel.reveal(new) == text


def test_short_numbers_with_a_check_digit():
    rng = random.Random(1)
    for n in (9, 10, 11, 12):
        for _ in range(50):
            head = "".join(rng.choice("0123456789") for _ in range(n - 1))
            d = head + str(feistel.luhn(head))
            new, found = feistel.pseudonymise(f"no {d}.")
            assert found == {"number": 1} and feistel.reveal(new) == f"no {d}." and feistel.luhn(new[3:-2]) == int(new[-2])


@pytest.mark.parametrize("n", [128, 129, 300, 100_000])
def test_long_secret(n):
    rng = random.Random(2)
    secret = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789") for _ in range(n))
    new, found = feistel.pseudonymise(f"token={secret} end")
    assert found == {"secret": 1} and feistel.reveal(new) == f"token={secret} end"
    assert not any(secret[i : i + 12] in new for i in range(0, min(n, 1000) - 12))
