"""Record schemas.

Partial dates stay structs (every component is nullable on its own), never
DateType. JSON integers are read as BIGINT, as Spark itself infers them.
"""

from pyspark.sql import types as T


def _s(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


STR, LONG, BOOL = T.StringType(), T.LongType(), T.BooleanType()
STRS = T.ArrayType(STR)

_DATE_CORE = [
    ("y", LONG), ("m", LONG), ("d", LONG), ("t", STR), ("weekday", STR), ("part", STR), ("season", STR),
    ("circa", BOOL), ("uncertain", BOOL), ("inferred", BOOL), ("bound", STR), ("certainty", STR),
]
RANGE_END = _s(("y", LONG), ("m", LONG), ("d", LONG), ("part", STR), ("season", STR), ("circa", BOOL))
PARTIAL_DATE = _s(*_DATE_CORE, ("to", RANGE_END))
ACT = _s(("date", PARTIAL_DATE), ("place", STR), ("time", STR))
ORDER_HINT = _s(("y", LONG), ("m", LONG), ("d", LONG), ("why", STR))
FACSIMILE = _s(("archive", STR), ("item", STR), ("pages", T.ArrayType(LONG)), ("caption", STR))
MANUSCRIPT = _s(("repository", STR), ("url", STR), ("archived_as", STR), ("owner", STR), ("recorded_by", STR), ("as_of", STR))
TURN = _s(("who", STR), ("text", STR))
SOURCE = _s(
    ("work", STR), ("locator", STR), ("locator_type", STR), ("quote", STR), ("context", STR), ("speaker", STR),
    ("addressee", STR), ("voice", STR), ("turns", T.ArrayType(TURN)), ("lang", STR), ("translation", STR),
    ("translation_note", STR), ("supports", STR), ("verified", BOOL), ("verified_on", STR), ("verified_with", STR),
    ("verified_against", STR), ("verified_against_original", BOOL), ("verified_marks", BOOL), ("document", STR),
    ("citation_provenance", STR), ("original_provenance", STR), ("letter_id", STR), ("letter_ids", STRS),
    ("facsimile", FACSIMILE), ("manuscript", MANUSCRIPT), ("written", ACT), ("sent", ACT), ("postmarked", ACT),
    ("received", ACT), ("occurred", ACT), ("order_hint", ORDER_HINT),
)
ENGAGEMENT = _s(
    ("subject", STR), ("name", STR), ("period", STR), ("date_label", STR), ("note", STR), ("start", ACT), ("end", ACT),
    ("sources", T.ArrayType(SOURCE)),
)
PERSON = _s(
    ("id", STR), ("name", STR), ("sort_name", STR), ("aka", STRS), ("born", ACT), ("died", ACT), ("group", STR),
    ("gender", STR), ("bio", STR), ("bio_note", STR), ("roster_note", STR), ("bio_sources", STRS),
    ("name_is_descriptor", BOOL), ("wikipedia", STR), ("wikidata", STR), ("sexuality_sources", T.ArrayType(ENGAGEMENT)),
)
DISPUTE = _s(("claim", STR), ("asserted_by", STR), ("disputed_by", STR), ("grounds", STR))
PHASE = _s(("start", ACT), ("end", ACT), ("note", STR))
NULL_FINDING = _s(("work", STR), ("checked_on", STR), ("finding", STR))
RELATIONSHIP = _s(
    ("id", STR), ("people", STRS), ("certainty", STR), ("certainty_status", STR), ("start", ACT), ("end", ACT),
    ("direction", STR), ("outcome", STR), ("places", STRS), ("date_label", STR), ("summary", STR),
    ("certainty_reasoning", STR), ("sources_order_note", STR), ("prior_class", STR), ("disputed", DISPUTE),
    ("phases", T.ArrayType(PHASE)), ("null_findings", T.ArrayType(NULL_FINDING)), ("sources", T.ArrayType(SOURCE)),
)
WORK = _s(
    ("author", STR), ("editors", STR), ("title", STR), ("year", LONG), ("short_cite", STR), ("kind", STR),
    ("publisher", STR), ("ia_id", STR), ("note", STR),
)
PLACE = _s(("venue", STR), ("street", STR), ("city", STR), ("region", STR), ("country", STR))
CREDIT = _s(("file", STR), ("licence", STR))
PAGE = _s(("page", LONG), ("pointer", STR), ("shelfmark", STR), ("rights", STR))
MATCH = _s(("letter_id", STR), ("pages", T.ArrayType(LONG)), ("what", STR), ("person", STR))
ITEM = _s(("itemId", STR), ("title", STR), ("boxFolder", STR), ("pages", T.ArrayType(PAGE)), ("matches", T.ArrayType(MATCH)))
MANIFEST = _s(
    ("collection", STR), ("download_url", STR),
    ("archive", _s(("name", STR), ("short_name", STR), ("collection", STR), ("collection_url", STR),
                   ("record_url", STR), ("iiif_url", STR), ("page_id_field", STR))),
    ("items", T.ArrayType(ITEM)),
)
TRANSCRIPTION = _s(
    ("letter_id", STR), ("transcribed_from", STR), ("printed", _s(("work", STR), ("locator", STR))),
    ("facsimile", FACSIMILE), ("sender", STR), ("addressee", STR), ("written", ACT), ("sent", ACT),
    ("postmarked", ACT), ("received", ACT), ("quote", STR), ("context", STR), ("verified_marks", BOOL),
    ("original_provenance", STR), ("transcribed_on", STR),
)
HEADING = _s(("file", STR), ("addressee", STR), ("quote", STR))
