"""The scalar functions by name in SQL: temporary functions whose bodies are SQL, so that Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import _ACCENTED, _ID_REVISION, _PLAIN, _SPEC, SEPARATORS

_LIKE = "value ILIKE replace({p}, '\\\\', '\\\\\\\\')"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions() -> dict[str, str]:
    """Name to signature and body."""
    return {
        "rich": f"""(value STRING, pattern STRING) RETURNS BOOLEAN RETURN CASE
            WHEN coalesce(pattern, '') = '' THEN true WHEN lower(trim(pattern)) = 'null' THEN value IS NULL WHEN lower(trim(pattern)) = 'not-null' THEN value IS NOT NULL
            WHEN startswith(pattern, '!') THEN NOT ({_LIKE.format(p='substr(pattern, 2)')}) ELSE {_LIKE.format(p='pattern')} END""",
        "tokens": f"""(value STRING) RETURNS ARRAY<STRING> RETURN
            filter(split(regexp_replace(translate(lower(value), {_quoted(_ACCENTED)}, {_quoted(_PLAIN)}), {_quoted(r'\p{Mn}+')}, ''), {_quoted(SEPARATORS)}), x -> x <> '')""",
        "normalize_ids": f"""(value STRING) RETURNS STRING RETURN
            regexp_replace(array_join(transform(split(regexp_replace(value, {_quoted(_ID_REVISION)}, '\\u0001$1\\u0002$2\\u0003'), '\\u0001'), (p, i) -> CASE WHEN i = 0 THEN p ELSE concat(
                upper(left(substring_index(p, '\\u0002', 1), 2)), lower(substr(substring_index(p, '\\u0002', 1), 3)), ' ',
                upper(left(substring_index(p, '\\u0002', 1), 2)), lower(substr(substring_index(p, '\\u0002', 1), 3)),
                lower(substring_index(substring_index(p, '\\u0003', 1), '\\u0002', -1)), substring_index(p, '\\u0003', -1)) END), ''), {_quoted(_SPEC)}, '$1$2_$3')""",
        "week_bucket": "(day DATE) RETURNS STRING RETURN concat(date_format(day, 'yyyy-MM'), '-W', CAST(floor((dayofmonth(day) - 1) / 7) + 1 AS STRING))",
        "collapse_spaces": "(value STRING) RETURNS STRING RETURN trim(regexp_replace(value, '(?U)[\\\\s\\\\x1c-\\\\x1f]+', ' '))",
    }


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Creates the functions in the session, under `prefix` and their names; gives those names."""
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}{body}")
    return [prefix + name for name in definitions()]
