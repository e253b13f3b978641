"""Scalar functions on text, identifiers, dates and lists, as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One class for everything that separates tokens.
SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"
SPACES = r"(?U)[\s\x1c-\x1f]+"
#: A document number (group letter, group, year and sequence, revision) and a specification number.
ID = r"[RSC][1-9P][-sw]\d{6,7}"
_ID_REVISION = rf"(?i)({ID})((?:r\d+)?)"
_SPEC = r"(?U)(^|\D)(\d+)\.(\d+(?:-\d+)?)"


def _folding() -> tuple[str, str]:
    """Letters with one diacritic that Unicode takes apart in a plain letter and a mark, and those plain letters."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        apart = unicodedata.normalize("NFD", c)
        if len(apart) == 2 and unicodedata.combining(apart[1]) and c == c.lower():
            pairs.append((c, apart[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTED, _PLAIN = _folding()


def fold_text(text: str) -> str:
    """What `tokens` makes of lower-case letters with diacritics, on the driver."""
    return re.sub(r"[\u0300-\u036f]", "", text.translate(str.maketrans(_ACCENTED, _PLAIN)))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: inside a lambda a plain expression is computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(text: Column, fold: bool = True) -> Column:
    """Lower-case words of letters and digits without diacritics, in order."""
    low = F.lower(text)
    if fold:  # only where there is a character of more than a byte
        plain = F.regexp_replace(F.translate(low, _ACCENTED, _PLAIN), r"\p{Mn}+", "")
        low = F.when(F.octet_length(low) > F.length(low), plain).otherwise(low)
    return F.filter(F.split(low, SEPARATORS), lambda x: x != "")


def collapse(text: Column) -> Column:
    """White space runs as single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize_ids(text: Column) -> Column:
    """Every document number as its base and itself, in their usual case; the first dot of a specification number as an underscore.

    `r5-1234567R2` gives `R5-1234567 R5-1234567r2`, a number without revision stands twice; `38.300-1` gives `38_300-1`.
    """
    parts = F.split(F.regexp_replace(text, _ID_REVISION, "\u0001$1\u0002$2\u0003"), "\u0001")

    def fix(p: Column, i: Column) -> Column:
        base = F.substring_index(p, "\u0002", 1)
        base = F.concat(F.upper(F.left(base, F.lit(2))), F.lower(F.substring(base, 3, 99)))
        revision = F.lower(F.substring_index(F.substring_index(p, "\u0003", 1), "\u0002", -1))
        return F.when(i == 0, p).otherwise(F.concat(base, F.lit(" "), base, revision, F.substring_index(p, "\u0003", -1)))

    return F.regexp_replace(F.array_join(F.transform(parts, fix), ""), _SPEC, "$1$2_$3")


def normalize_path(url: Column) -> Column:
    """Site-free, lower-case path with single slashes."""
    x = F.regexp_replace(F.trim(url), r"\\", "/")
    x = F.regexp_replace(x, r"(?i)^(https?|ftp)://[^/]*", "")
    return F.lower(F.regexp_replace(F.regexp_replace(x, "/+", "/"), "^/", ""))


def document_id(url: Column, member: Column) -> Column:
    """SHA-256 of the compact JSON list of both."""
    return F.sha2(F.to_json(F.array(url, member)), 256)


def chunk_id(*parts: Column) -> Column:
    return F.concat_ws("#", *[p.cast("string") for p in parts])


def version_key(version: Column) -> Column:
    """Numbers of a dotted version; what isn't a number is 0. Arrays compare in order."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def release_name(text: Column) -> Column:
    """`Release 20` gives `Rel-20`, `Release 1999` gives `R99`; anything else stays, trimmed."""
    n = F.regexp_extract(F.trim(text), r"(?i)^Release\s+(\d+)$", 1)
    return F.when(n == "1999", "R99").when(n != "", F.concat(F.lit("Rel-"), n)).otherwise(F.trim(text))


def cover_release(text: Column) -> Column:
    """A cover page's release: `Release 17` and `Rel17` give `Rel-17`; anything else stays as it is."""
    n = F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"(?i)^Release\s+(\S+)$", r"(?i)^Rel(\d+)$")))
    return F.when(n.isNotNull(), F.concat(F.lit("Rel-"), n)).otherwise(text)


def id_year(number: Column) -> Column:
    """The two-digit year in a document number, null for anything else."""
    return F.nullif(F.regexp_extract(number, r"(?i)^[RSC][1-9P][-sw](\d{2})\d{4,5}(?:r\d)?$", 1), F.lit("")).cast("int")


def id_parts(number: Column) -> tuple[Column, Column]:
    """Prefix (three characters) and number of a label of nine or ten characters whose fourth is a digit; nulls otherwise."""
    ok = F.length(number).isin(9, 10) & F.substring(number, 4, 1).rlike("^[0-9]")
    return F.when(ok, F.left(number, F.lit(3))), F.when(ok, F.regexp_extract(F.substring(number, 4, 99), "^([0-9]+)", 1).cast("bigint"))


def group_code(name: Column) -> Column:
    """`RAN WG1` and `ran 1` give `R1`; the four plenary codes stay; null for anything else."""
    up = F.upper(collapse(name))
    family, n = F.regexp_extract(up, r"^(RAN|CT|SA)\s*(?:WG)?\s*(\d+)$", 1), F.regexp_extract(up, r"^(RAN|CT|SA)\s*(?:WG)?\s*(\d+)$", 2)
    return F.when(n != "", F.concat(F.left(family, F.lit(1)), n)).when(up.isin("RT", "RP", "CP", "SP"), up)


def list_group(list_id: Column) -> Column:
    """The group code of a mailing list's id: its working group's, else its plenary's; null for lists of other families."""
    up = F.upper(F.trim(list_id))
    family = F.regexp_extract(up, r"^3GPP_TSG_(RAN|SA|CT)(?:_|$)", 1)
    n = F.regexp_extract(up, r"^3GPP_TSG_(?:RAN|SA|CT)_WG([0-9]+)(?:_|$)", 1)
    return F.when(family != "", F.concat(F.left(family, F.lit(1)), F.when(n != "", n).otherwise("P")))


def technology(spec: Column) -> Column:
    """The technology that a test specification is about; empty for others."""
    # fixed values
    known = {"34.229": "IMS", "37.579": "MCX", "36.579": "MCX", "37.571": "POS", "38.523": "5G", "36.523": "LTE"}
    base = F.regexp_extract(F.trim(spec), r"^(\d+\.\d+)", 1)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[base], F.lit(""))


def module_name(path: Column) -> Column:
    """The last name in a module's path, without `.ttcn`; a line break mark after it doesn't count."""
    low = F.lower(path)
    bare = F.when(F.endswith(low, F.lit("<br>")), F.left(path, F.length(path) - 4)).otherwise(path)
    bare = F.when(F.endswith(F.lower(bare), F.lit(".ttcn")), F.left(bare, F.length(bare) - 5)).otherwise(bare)
    return F.nullif(F.element_at(F.split(bare, "[^A-Za-z0-9_]"), -1), F.lit(""))


#: Prefixes of function names.
FUNCTION_PREFIXES = "f_ fl_ fx_ a_ tsc_ cs_ cr_ crs_ cas_ car_ cds_ cdr_ cms_ cmr_ cads_".split()


def function_name(text: Column) -> Column:
    """The first name with one of the known prefixes, or that ends in `_type`."""
    pattern = rf"(?i)((?:{'|'.join(FUNCTION_PREFIXES)})[a-z_0-9]+|[a-z_0-9]+_type)"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def changed_functions(changes: Column) -> Column:
    """Sorted distinct `module.function` of an array of structs (ttcn_module, function_name); one of both may be missing, its dot stays."""
    def entry(x: Column) -> Column:
        m, f = module_name(x["ttcn_module"]), function_name(x["function_name"])
        return F.when(m.isNotNull() | f.isNotNull(), F.concat(F.coalesce(m, F.lit("")), F.lit("."), F.coalesce(f, F.lit(""))))

    return F.array_sort(F.array_distinct(F.filter(F.transform(changes, entry), lambda x: x.isNotNull())))


def release_of_version(version: Column) -> Column:
    major = F.element_at(F.split(version, r"\."), 1).try_cast("int")
    return F.when(major.isNull(), None).when(major == 0, "draft").when(major < 4, "pre-release").otherwise(F.concat(F.lit("Rel-"), major.cast("string")))


def week_bucket(day: Column) -> Column:
    """YYYY-MM-Wn with n counted from the first of the month."""
    n = F.floor((F.dayofmonth(day) - 1) / 7) + 1
    return F.concat(F.date_format(day, "yyyy-MM"), F.lit("-W"), n.cast("string"))


def period_key(bucket: Column) -> Column:
    """Sort key of YYYY-MM or YYYY-MM-Wn."""
    week = F.regexp_extract(bucket, r"-W(\d+)$", 1)
    return F.substring(bucket, 1, 4).cast("int") * 1200 + F.substring(bucket, 6, 2).cast("int") * 100 + F.coalesce(F.nullif(week, F.lit("")).try_cast("int"), F.lit(0))


def parse_date(text: Column) -> Column:
    """ISO, then slashes year first, then day/month/year, then month/day/year; null if none fits."""
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "d/M/yyyy", "M/d/yyyy")])


def period_near(bucket: Column, first, last) -> Column:
    """Whether a month bucket lies between two days' months or next to them; an absent day is an open side."""
    month = F.substring(bucket, 1, 4).cast("int") * 12 + F.substring(bucket, 6, 2).cast("int")
    low = F.lit(True) if first is None else month >= first.year * 12 + first.month - 1
    high = F.lit(True) if last is None else month <= last.year * 12 + last.month + 1
    return low & high


#: What an address begins with.
_SCHEMES = r"(?:https?|ftp)://|mailto:"


def strip_urls(text: Column) -> Column:
    """Links become their label; angle and bare addresses and `www.` hosts go. Lines stay, trimmed, with single blanks; empty ones go."""
    def unlinked(line: Column) -> Column:
        # from each `](` back to its `[`: the label; a label may hold a link itself
        for _ in range(2):
            line = F.regexp_replace(line, rf"(?i)\[([^\[\]]*)\]\((?=\s*(?:{_SCHEMES}|[/#]))[^()]*\)", "$1")
        return line

    def kept(word: Column) -> Column:
        """A word up to the address in it, and what follows the bracket that closes it."""
        return F.regexp_replace(word, rf"(?i)(?:<|&lt;)(?:{_SCHEMES})[^<>]+?(?:>|&gt;)|(?<![a-z0-9_])(?:{_SCHEMES}|www\.(?=[a-z0-9.-]*\.[a-z]{{2}})).+", " ")

    lines = F.split(text, r"\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]")
    words = lambda line: F.split(unlinked(line), r"[ \t]+")
    lines = F.transform(lines, lambda line: F.trim(F.regexp_replace(F.array_join(F.transform(words(line), kept), " "), " +", " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def strip_markdown(text: Column) -> Column:
    """Text without emphasis, heading and quote marks, rules, link targets and code ticks; escaped marks stay as plain ones.

    Lines lose what stands before their text; then the marks within are taken off in pairs, outermost first.
    """
    def bare(line: Column) -> Column:
        marks = F.trim(line)
        rule = (F.length(marks) >= 3) & ((F.replace(marks, F.lit("-"), F.lit("")) == "") | (F.replace(marks, F.lit("="), F.lit("")) == ""))
        return F.when(rule, "").otherwise(F.regexp_replace(line, r"^(?:#+|>)\s*", ""))

    # escaped marks are put aside as characters that no text has
    aside = F.replace(F.replace(text, F.lit("\\*"), F.lit("\ue0f0")), F.lit("\\_"), F.lit("\ue0f1"))
    out = F.array_join(F.transform(F.split(aside, "\n"), bare), "\n")
    pairs = r"\*\*(?=[^\s*])(.+?)(?<=\S)\*\*|__(?=[^\s_])(.+?)(?<=\S)__|\*(?=[^\s*])(.+?)(?<=\S)\*|_(?=[^\s_])(.+?)(?<=\S)_|\[([^\]]+)\]\([^)]+\)|`([^`]+)`"
    for _ in range(3):  # pairs within pairs
        out = F.regexp_replace(out, pairs, "$1$2$3$4$5$6")
    out = F.replace(F.replace(out, F.lit("\ue0f0"), F.lit("*")), F.lit("\ue0f1"), F.lit("_"))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


#: Fixed value: a document number as texts name it, without its revision.
TEXT_ID = r"[RSC][1-6P][-sw]\d{6,7}"


def ids_in(*texts: Column) -> Column:
    """Document numbers met in texts and their percent-decoded forms, without revisions, in upper case, first seen first."""
    found = [F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(rf"(?i)({TEXT_ID})"), F.lit(1)) for t in texts for x in (t, F.try_url_decode(t))]
    return F.array_distinct(F.transform(F.flatten(F.array(*found)), F.upper))


def upper_list(text: Column, separator: str = ",") -> Column:
    """A delimited list as distinct upper-case members, first seen first."""
    return F.array_distinct(F.filter(F.transform(F.split(text, separator), lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda x: x != "")


def preview(text: Column, n: int = 200) -> tuple[Column, Column]:
    """The first n characters, and whether there are more."""
    return F.left(text, F.lit(n)), F.length(text) > n


def newest(items: Column, n: int = 50) -> Column:
    """The last n of a list."""
    return F.when(F.size(items) > n, F.slice(items, -n, n)).otherwise(items)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


#: Formats of mail dates, with their precision.
_MAIL_DATES = (
    ("yyyy-MM-dd", "date"), ("d MMM yyyy", "date"), ("d MMMM yyyy", "date"), ("MMM d yyyy", "date"), ("MMMM d yyyy", "date"),
    ("yyyy-MM-dd HH:mm:ss", "datetime"), ("yyyy-MM-dd HH:mm", "datetime"), ("d MMM yyyy HH:mm:ss", "datetime"), ("d MMM yyyy HH:mm", "datetime"), ("d MMMM yyyy HH:mm:ss", "datetime"), ("d MMMM yyyy HH:mm", "datetime"),
)


def mail_date(text: Column) -> Column:
    """A mail's date as a struct (local timestamp without zone, utc, offset_seconds, precision); null where no format fits.

    ISO and RFC 2822 forms, with or without a weekday, a zone offset or `Z`; a date alone has the precision `date`.
    """
    x = F.regexp_replace(F.regexp_replace(collapse(text), r"^[A-Za-z]{3,9},\s*", ""), r",", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\s*\((?:[A-Za-z0-9+: -]+)\)$", ""), r"(?<=\d)T(?=\d)", " ")
    x = F.regexp_replace(x, r"\.\d+(?=$|\s*[Zz+-])", "")
    zone = F.regexp_extract(x, r"(?<=[\d ])(Z|z|GMT|UTC|UT|[+-]\d{2}:?\d{2})$", 1)
    zone = F.when(x.rlike(r"\d{1,2}:\d{2}"), zone).otherwise("")
    bare = F.trim(F.substring(x, F.lit(1), F.length(x) - F.length(zone)))
    digits = F.regexp_replace(zone, ":", "")
    seconds = F.when(zone.rlike("^[+-]"), F.when(zone.startswith("-"), -1).otherwise(1) * (F.substring(digits, 2, 2).try_cast("int") * 3600 + F.substring(digits, 4, 2).try_cast("int") * 60)).when(zone != "", 0)
    stamps = [(F.try_to_timestamp(bare, F.lit(f)).cast("timestamp_ntz"), p) for f, p in _MAIL_DATES]
    local = F.coalesce(*(t for t, _ in stamps))
    precision = F.coalesce(*(F.when(t.isNotNull(), F.lit(p)) for t, p in stamps))
    utc = F.timestamp_seconds(F.unix_timestamp(local.cast("timestamp")) - F.coalesce(seconds, F.lit(0))).cast("timestamp_ntz")
    return F.when(local.isNotNull(), F.struct(local.alias("local"), utc.alias("utc"), seconds.alias("offset_seconds"), precision.alias("precision")))


def status_archive_key(name: Column) -> Column:
    """(year, week, revision) of a status archive's file name, null for other names; the greatest is the latest."""
    pattern = r"(?i)TTCN CR Agreement Status (\d{4})-wk(\d{2})(?:[_-]?(?:r|rev)(\d+))?\.zip$"
    part = lambda i: F.regexp_extract(F.trim(name), pattern, i)
    return F.when(part(1) != "", F.struct(part(1).cast("int").alias("year"), part(2).cast("int").alias("week"), F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0)).alias("revision")))


def file_class(name: Column, number: Column, folder: Column) -> Column:
    """draft, revision, review or support of a file that carries a document number not followed by a digit; null for others and for the document's own archive."""
    low = F.lower(name)
    known = low.rlike(r"\.(?:zip|docx?|pptx?)$") & F.regexp_like(low, F.concat(F.lit(r"\Q"), F.lower(number), F.lit(r"\E(?!\d)"))) & (low != F.concat(F.lower(number), F.lit(".zip")))
    in_review = F.when(F.contains(low, F.lit("mcc160comment")), "review").otherwise("support")
    return F.when(known, F.when(F.lower(folder) == "review", in_review).when(low.startswith("draft"), "draft").otherwise("revision"))


def section_key(section: Column) -> Column:
    """A section number's natural order: digits by value before letters; null if a part holds anything else."""
    tokens_ = F.transform(
        F.regexp_extract_all(section, F.lit(r"(\d+|[A-Za-z]+|\.)"), F.lit(1)),
        lambda t: F.when(t == ".", F.struct(F.lit(-1).alias("kind"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("s")))
        .when(t.rlike("^[0-9]"), F.struct(F.lit(0).alias("kind"), t.try_cast("bigint").alias("n"), F.lit("").alias("s")))
        .otherwise(F.struct(F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("n"), F.lower(t).alias("s"))),
    )
    return F.when(section.rlike(r"^[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*$"), tokens_)


def duration_seconds(text: str) -> float:
    """Seconds of `24h`, `30m`, `90d`, `15s` or an ISO 8601 duration; ValueError for anything else."""
    units = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([smhd])", text.strip(), re.I)
    if m:
        return float(m[1]) * units[m[2].lower()]
    n = r"(?:(\d+(?:\.\d+)?){})?"
    m = re.fullmatch("P" + n.format("W") + n.format("D") + "(?:T" + n.format("H") + n.format("M") + n.format("S") + ")?", text.strip(), re.I)
    if not m or not any(m.groups()):
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(x) * units[u] for x, u in zip(m.groups(), "wdhms", strict=True) if x)


def duration_text(seconds: Column) -> Column:
    """`42s`, `5m`, `2h 30m`, `1d 6h`: the largest unit and, for hours and days, the next."""
    n = seconds.cast("bigint")
    whole = lambda unit: F.floor(n / unit).cast("bigint").cast("string")
    rest = lambda big, small: F.floor((n % big) / small)
    more = lambda big, small, name: F.when(rest(big, small) > 0, F.concat(F.lit(" "), rest(big, small).cast("string"), F.lit(name))).otherwise("")
    return (
        F.when(n < 60, F.concat(n.cast("string"), F.lit("s")))
        .when(n < 3600, F.concat(whole(60), F.lit("m")))
        .when(n < 86400, F.concat(whole(3600), F.lit("h"), more(3600, 60, "m")))
        .otherwise(F.concat(whole(86400), F.lit("d"), more(86400, 3600, "h")))
    )
