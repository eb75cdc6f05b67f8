"""Text normalization as Column expressions.

Java's \\s and \\w are ASCII-only and Spark's trim strips only spaces, so the white space of Unicode
text is spelled out where the rules need it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"
#: Quotes that normalize_text strips.
QUOTES = "\"'“”‘’`"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def clean_text(text: Column) -> Column:
    """NULs become spaces, runs of blanks one space, three or more line ends two; ends stripped."""
    spaced = F.regexp_replace(blank_if_null(text), "\x00", " ")
    spaced = F.regexp_replace(spaced, r"[ \t\r\f\x0B]+", " ")
    return strip(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


#: Letters whose full upper case is several letters, and the one capital that they have; others of that kind have none.
CAPITALS = {c: chr(ord(c) + 8) for c in map(chr, [*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8)])} | {"ß": "ẞ", "ᾳ": "ᾼ", "ῃ": "ῌ", "ῳ": "ῼ"}


def simple_upper(text: Column) -> Column:
    """Upper case letter by letter, as SQL has it: ß becomes ẞ, a letter without a single capital stays."""
    letters = F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)
    single = lambda c: F.translate(c, "".join(CAPITALS), "".join(CAPITALS.values()))
    return F.array_join(F.transform(letters, lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(single(c))), "")


def compact_text(text: Column, max_chars: int = 0) -> Column:
    """One line; longer than max_chars: the first max_chars - 1, right-stripped, and an ellipsis of three points."""
    flat = collapse(clean_text(text))
    if not max_chars:
        return flat
    return F.when(F.length(flat) > max_chars, F.concat(rstrip(F.substring(flat, 1, max_chars - 1)), F.lit("..."))).otherwise(flat)


def normalize_text(text: Column) -> Column:
    """Strip, lower-case, strip quotes, collapse white space; blanks within the quotes stay at the ends."""
    low = F.lower(strip(blank_if_null(text)))
    bare = F.regexp_replace(F.regexp_replace(low, f"^[{QUOTES}]+", ""), f"[{QUOTES}]+$", "")
    return collapse(bare)


def normalize_id(text: Column) -> Column:
    return strip(blank_if_null(text))


def normalize_visible_id(text: Column, prefix: str) -> Column:
    """"Table 4", "table4" and "4" are "table 4"; other names stay as normalized."""
    low = normalize_text(text)
    number = F.regexp_extract(low, rf"^(?:{prefix.lower()}\s*)?([0-9]+[a-z]?)$", 1)
    return F.when(number != "", F.concat(F.lit(f"{prefix.lower()} "), number)).otherwise(low)


def normalize_object_id(text: Column) -> Column:
    """The bare number of "Table 4", "Figure 4" or "4", else the normalized, stripped text."""
    low = strip(normalize_text(text))
    number = F.regexp_extract(low, r"^(?:(?:table|figure|fig\.?)\s*)?([0-9]+[a-z]?)$", 1)
    return F.when(number != "", number).otherwise(low)


def normalize_alias(text: Column) -> Column:
    """Lower-cased base name without .pdf, letters and digits only."""
    low = F.lower(strip(blank_if_null(text)))
    base = F.substring_index(F.replace(low, F.lit("\\"), F.lit("/")), "/", -1)
    return F.regexp_replace(F.regexp_replace(base, r"\.pdf$", ""), "[^a-z0-9]+", "")


def normalize_title(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(blank_if_null(text)), "[^a-z0-9]+", " "))


def titles_equivalent(a: Column, b: Column, least: int = 15) -> Column:
    """Equal when normalized or one a prefix of the other, both of at least least characters."""
    x, y = normalize_title(a), normalize_title(b)
    return (F.length(x) >= least) & (F.length(y) >= least) & ((x == y) | x.startswith(y) | y.startswith(x))


def looks_like_title(text: Column) -> Column:
    """40 characters and four words at least, 45 % of the words with a capital."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z][\p{L}\p{N}_-]*)"), 1)
    capital = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    return F.coalesce((F.length(strip(text)) >= 40) & (F.size(words) >= 4) & (capital / F.greatest(F.size(words), F.lit(1)) >= 0.45), F.lit(False))


def strip_thousands(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")


def normalize_plus_minus(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*(?:±|\+/-|\+-)\s*", " ± ")


def table_cell(text: Column) -> Column:
    return strip(normalize_plus_minus(collapse(blank_if_null(text))))


def normalize_number(text: Column) -> Column:
    """The number that the text spells, percent signs dropped; null where it spells none."""
    bare = F.replace(strip(blank_if_null(text)), F.lit("%"), F.lit(""))
    bare = strip(bare)
    plain = bare.rlike(r"^[+-]?(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9]+)?$")
    return F.when(plain, F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))


def isclose(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def cell_equal(gold: Column, pred: Column, kind: Column) -> Column:
    """Nulls equal each other only; numbers within 1e-6; booleans by being non-empty; other types as normalized text."""
    x, y = normalize_number(gold), normalize_number(pred)
    return (
        F.when(gold.isNull() | pred.isNull(), gold.isNull() & pred.isNull())
        .when(kind == "number", F.coalesce(isclose(x, y), F.lit(False)))
        .when(kind == "boolean", (gold != "") == (pred != ""))
        .otherwise(normalize_text(gold) == normalize_text(pred))
    )


def base64_key(*parts: Column) -> Column:
    """URL-safe base64 of the parts joined by colons, without padding or line breaks."""
    raw = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.regexp_replace(F.translate(F.base64(F.encode(raw, "UTF-8")), "+/\r\n", "-_"), "=+$", "")


def token_pattern(token: str) -> str:
    """Pattern for a token that no ASCII letter or digit touches, case-sensitive."""
    return rf"(?<![A-Za-z0-9])\Q{token}\E(?![A-Za-z0-9])"


def match_text(text: Column) -> Column:
    """Lower case, one blank for white space, spaced plus-minus signs: the form in which values are looked for."""
    return table_cell(F.lower(blank_if_null(text)))


#: What a numeric value is made of.
NUMERIC_VALUE = r"^[0-9.,%±\s+-]+$"


def contains_value(text: Column, value: Column) -> Column:
    """Containment in the form of match_text, with or without thousands separators; no digit or point may touch a numeric value."""
    content, needle = match_text(text), match_text(value)
    bare = strip_thousands(content)

    def found(variant: Column) -> Column:
        pattern = F.concat(F.lit(r"(?<![0-9.])\Q"), variant, F.lit(r"\E(?![0-9.])"))
        inside = F.regexp(content, pattern) | F.regexp(bare, pattern)
        return F.when(variant.rlike(NUMERIC_VALUE), inside).otherwise((F.instr(content, variant) > 0) | (F.instr(bare, variant) > 0))

    return (needle != "") & (found(needle) | found(strip_thousands(needle)))


def match_values(freeform: Column, letter: Column, options: Column) -> Column:
    """Final answer strings worth finding: free text, then the chosen option's text; distinct, two characters of a number or three of a word at least."""
    key = F.upper(strip(blank_if_null(letter)))
    chosen = F.filter(F.map_entries(options), lambda e: F.upper(strip(e["key"])) == key)
    option = F.when((key != "") & (F.size(chosen) > 0), strip(blank_if_null(F.element_at(chosen, -1)["value"])))
    both = F.filter(F.array(strip(blank_if_null(freeform)), F.coalesce(option, F.lit(""))), lambda v: match_text(v) != "")
    long = F.filter(both, lambda v: F.length(match_text(v)) >= F.when(match_text(v).rlike(NUMERIC_VALUE), 2).otherwise(3))
    return F.when((F.size(long) == 2) & (match_text(F.get(long, F.lit(0))) == match_text(F.get(long, F.lit(1)))), F.slice(long, 1, 1)).otherwise(long)


def numeric_cells(cells: Column) -> Column:
    """Distinct numeric values of two characters or more of an array of table cells, as they are written, in order."""
    kept = F.filter(cells, lambda c: match_text(c).rlike(NUMERIC_VALUE) & (F.length(match_text(c)) >= 2))
    norm = F.transform(kept, match_text)
    return F.filter(F.transform(kept, lambda c, i: F.when(F.array_position(norm, F.get(norm, i)) == i + 1, c)), lambda c: c.isNotNull())


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """template with each {name} replaced by its value; a value's own braces are left alone."""
    out = F.concat(F.lit("\x01"), template)
    for i, name in enumerate(values):
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(f"\x01{i}\x01"))
    for i, value in enumerate(values.values()):
        out = F.replace(out, F.lit(f"\x01{i}\x01"), blank_if_null(value))
    return F.substring(out, F.lit(2), F.length(out))


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(blank_if_null(text)), F.lit(f"({TOKEN})"), 1)


def error_class(error: Column, status: Column) -> Column:
    """"HTTP n" where a status is known, else what stands before the first colon, else unknown."""
    head = strip(F.substring_index(blank_if_null(error), ":", 1))
    return F.when(status.isNotNull(), F.concat(F.lit("HTTP "), status.cast("string"))).when(head != "", head).otherwise("unknown")


#: HTTP statuses that are worth another try.
TRANSIENT_STATUSES = (408, 409, 425, 429, 500, 502, 503, 504)


def is_transient(status: Column, error: Column) -> Column:
    return F.coalesce(status.isin(*TRANSIENT_STATUSES), F.lit(False)) | F.lower(blank_if_null(error)).rlike("timeout|timed out|connection reset|temporarily")


def backoff_seconds(attempt: Column, base: float, cap: float, least: float = 0.0) -> Column:
    """Capped exponential delay without its jitter."""
    return F.greatest(F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap)), F.lit(least))


#: Patterns of questions that list or compare papers.
ENUMERATION_PATTERNS = (
    r"\bwhich papers\b",
    r"\bwhat papers\b",
    r"\blist (all|the)\b",
    r"\ball (of the )?papers (that|which)\b",
    r"\bevery paper\b",
    r"\bhow many papers\b",
    r"\bcompare\b",
    r"\bcomparison (of|between)\b",
    r"\bacross (the )?(papers|studies|works)\b",
    r"\bboth .+ and .+\b",
)
SINGLE, MULTI = "hidden_source_single_paper", "multi_paper"


def is_enumeration(question: Column) -> Column:
    low = F.lower(blank_if_null(question))
    out = F.lit(False)
    for pattern in ENUMERATION_PATTERNS:
        out = out | low.rlike(pattern)
    return out


def task_family(question: Column) -> Column:
    low = F.lower(blank_if_null(question))
    return F.when(is_enumeration(question) | low.rlike(r"\bpapers\b") | low.rlike(r",\s*[^,]+,?\s+and\s+"), MULTI).otherwise(SINGLE)


def l2_normalize(vector: Column) -> Column:
    """Unit vector of doubles; a zero vector stays as it is."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def url_host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")))


def url_stem(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def parse_levels(text: Column) -> Column:
    """Sorted distinct positive integers of a comma list."""
    numbers = F.transform(F.split(blank_if_null(text), ","), lambda x: strip(x).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x > 0)))


def json_object(text: Column) -> Column:
    """The JSON object that a text holds: the text itself, else what stands from its first { to its last }."""
    whole = strip(blank_if_null(text))
    inner = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    is_object = lambda x: F.coalesce(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object(whole), whole).when((inner != "") & is_object(inner), inner)


def choice_letter(raw: Column, options: Column) -> Column:
    """The option letter that an answer names: as a letter, as an option's text, or as the one option it contains (3+ characters)."""
    low = strip(collapse(F.lower(blank_if_null(raw))))
    entries = F.map_entries(options)
    letter = F.upper(F.regexp_extract(low, r"^(?:option\s+|answer\s*:?\s*)?\(?([a-z])\)?[.:)]?$", 1))
    norm = lambda x: strip(collapse(F.lower(blank_if_null(x))))
    exact = F.filter(entries, lambda e: norm(e["value"]) == low)
    inside = F.filter(entries, lambda e: (F.length(norm(e["value"])) >= 3) & (F.instr(low, norm(e["value"])) > 0))
    return F.coalesce(
        F.when((letter != "") & F.map_contains_key(options, letter), letter),
        F.when(F.size(exact) > 0, F.get(exact, F.lit(0))["key"]),
        F.when(F.size(inside) == 1, F.get(inside, F.lit(0))["key"]),
    )
