"""Text expressions: terms, evidence, projections of JSON records, categories, failures."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories and the words that decide them, in order; the first group that occurs in the path wins.
CATEGORY_WORDS = {
    "Entertainment": ("movie", "film", "anime", "animation", "concert", "music", "episode"),
    "People": ("family", "friend", "people", "person", "wedding", "birthday", "party", "baby"),
    "Places": ("travel", "trip", "vacation", "city", "street", "hotel", "museum", "beach"),
    "Nature": ("nature", "sunset", "forest", "mountain", "ocean", "lake", "garden", "landscape"),
    "Food": ("food", "cook", "meal", "dinner", "lunch", "breakfast", "restaurant", "coffee"),
    "Sports": ("sport", "game", "football", "soccer", "basketball", "tennis", "gym", "run"),
    "Animals": ("animal", "pet", "cat", "dog", "bird", "wildlife", "zoo"),
    "Vehicles": ("car", "drive", "traffic", "train", "plane", "flight", "bike", "vehicle"),
    "Work": ("work", "meeting", "screen", "computer", "presentation", "office", "tutorial"),
}

# MIME types by extension.
MIME_TYPES = {
    "mp4": "video/mp4",
    "m4v": "video/mp4",
    "mov": "video/quicktime",
    "mkv": "video/x-matroska",
    "avi": "video/x-msvideo",
    "webm": "video/webm",
    "wmv": "video/x-ms-wmv",
    "mpg": "video/mpeg",
    "mpeg": "video/mpeg",
}


def category_of_path(path: Column) -> Column:
    """By substrings of the path, ASCII case ignored."""
    low = F.translate(path, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = None
    for name, words in CATEGORY_WORDS.items():
        hit = low.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Unsorted")


def mime_of_path(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MIME_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))), F.lit("application/octet-stream"))


def terms(text: Column, most: int | None = None) -> Column:
    """Runs of letters and digits, lower-cased and without diacritics; the first `most` of them."""
    found = F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return found if most is None else F.slice(found, 1, most)


def _plain_letters() -> tuple[str, str]:
    """Latin letters whose decomposition is an ASCII letter and marks, and these letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha() and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(code), base[0].lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _plain_letters()


def fold(text: Column) -> Column:
    """Lower case, Latin diacritics removed, combining marks dropped: what full-text terms are compared by."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), _ACCENTED, _PLAIN)


def casefold(text: Column) -> Column:
    """Lower case, with sharp s as ss and final sigma as sigma."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ς", "σ")


def collapse_spaces(text: Column) -> Column:
    """Without case, each run of white space one blank: what text observations are compared by."""
    return F.trim(F.regexp_replace(casefold(text), r"\s+", " "))


def evidence(text: Column, most: int = 240) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def short_error(text: Column) -> Column:
    return F.left(text, F.lit(500))


#: What errors say that stay however often a chunk is tried again.
PERMANENT = ("oom", "out of memory", "invalid data", "could not decode", "no such file")


def is_permanent_failure(error: Column, not_found: Column | None = None) -> Column:
    known = F.lower(error).rlike("|".join(PERMANENT))
    return known if not_found is None else known | not_found


def labelled_lines(fields: dict[str, Column]) -> Column:
    """"name: value" lines of the fields that are not blank, arrays joined by ", "."""
    return F.concat_ws("\n", *(F.when(v.rlike(r"(?U)\S"), F.concat(F.lit(f"{k}: "), F.trim(v))) for k, v in fields.items()))


def searchable_text(modality: Column, data: Column) -> Column:
    """What is searched of a record (variant): a caption's parts joined by a middle dot, the text of ocr and transcript, else nothing."""

    def part(name: str) -> Column:
        return F.regexp_replace(F.trim(F.try_variant_get(data, f"$.{name}", "string")), r"[.,;:!?]+$", "")

    def parts(name: str) -> Column:
        each = F.coalesce(F.try_variant_get(data, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
        return F.filter(F.transform(each, lambda x: F.trim(x)), lambda x: x != "")

    single = F.filter(F.array(*(part(x) for x in ("description", "setting", "camera_motion"))), lambda x: x.isNotNull() & (x != ""))
    caption = F.array_join(F.concat(single, parts("activities"), parts("salient_objects")), " · ")
    plain = F.coalesce(F.trim(F.try_variant_get(data, "$.text", "string")), F.lit(""))
    return F.when(modality == "scene_caption", caption).when(modality.isin("ocr", "transcript"), plain).otherwise("")


def rescued_json(text: Column, fallback_field: str = "description") -> Column:
    """A model's answer as variant: code fences off, the outermost object; else an object flagged parse_fallback."""
    bare = F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", "")
    found = F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))
    flagged = F.to_json(F.struct(F.trim(text).alias(fallback_field), F.lit(True).alias("parse_fallback")))
    return F.coalesce(found, F.parse_json(flagged))


def content_hash(canonical: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))
