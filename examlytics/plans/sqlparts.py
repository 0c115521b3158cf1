"""DuckDB SQL fragments for the oracle. The patterns are written out here, in
RE2 syntax, and not taken from the Spark expressions they check. Used only to
build ``oracle_sql()`` strings; nothing here runs on Spark.
"""

from __future__ import annotations

# White space of Python's str.strip, as a character class body.
PY_WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rep(r: str) -> str:
    """Java ``$n`` back-references to RE2 ``\\n``."""
    out = r
    for i in range(9, 0, -1):
        out = out.replace(f"${i}", f"\\{i}")
    return out


def re_all(x: str, pat: str, rep: str) -> str:
    return f"regexp_replace({x}, {lit(pat)}, {lit(_rep(rep))}, 'g')"


def py_strip(x: str) -> str:
    return re_all(x, f"^[{PY_WHITESPACE}]+|[{PY_WHITESPACE}]+$", "")


def has_text(x: str) -> str:
    return f"({x} IS NOT NULL AND {py_strip(x)} <> '')"


def fix_qno(x: str, null_as: str | None = None) -> str:
    if null_as is not None:
        x = f"coalesce({x}, {lit(null_as)})"
    x = f"regexp_replace({x}, '(\\d+)\\.([a-z]+)\\.([ivx]+)', '\\1(\\2)(\\3)', 'g')"
    x = f"regexp_replace({x}, '(\\d+)\\.([a-z]+)', '\\1(\\2)', 'g')"
    x = f"regexp_replace({x}, '(\\d+)\\.[(]([a-z])[)]\\.([ivx]+)', '\\1(\\2)(\\3)', 'g')"
    return py_strip(f"replace(replace({x}, '.(', '('), ' ', '')")


def standard_qno(x: str) -> str:
    return f"regexp_replace({x}, '(\\d+)([a-z])', '\\1(\\2)', 'g')"


def normalize_qno(x: str, null_as: str | None = None) -> str:
    return standard_qno(fix_qno(x, null_as))


def main_qno(x: str) -> str:
    return f"split_part({x}, '(', 1)"


def sub_qno(x: str) -> str:
    """Main number and first bracket group, by position instead of a pattern."""
    rest = f"split_part({x}, '(', 2)"
    return f"CASE WHEN contains({x}, '(') THEN split_part({x}, '(', 1) || '(' || split_part({rest}, ')', 1) || ')' ELSE {x} END"


def base_qno(x: str) -> str:
    return py_strip(f"regexp_replace({py_strip(x)}, {lit('[' + PY_WHITESPACE + '_]*([(][ivx]+[)]|[ivx]+)$')}, '', 'g')")


def integer_text(x: str) -> str:
    inner = re_all(re_all(x, "\\.0+$", ""), "^0+([0-9])", "$1")
    return f"CASE WHEN regexp_matches({x}, '^[0-9]+(\\.0+)?$') THEN {inner} ELSE {x} END"


def strip_junk(x: str) -> str:
    return f"translate({x}, '()[]''', '')"


def normalize_answer(x: str) -> str:
    return re_all(py_strip(f"lower({x})"), "\\s+", " ")


def delimit_cell(x: str) -> str:
    return py_strip(re_all(py_strip(x), "[" + PY_WHITESPACE + "._()]+", " "))


def letter_parts(x: str) -> str:
    return f"list_aggregate(list_transform(regexp_extract_all({x}, '([A-Za-z]+)', 1), lambda v: '(' || v || ')'), 'string_agg', '')"


def percent_text(num: str, den: str, decimals: int = 1) -> str:
    scale = 10 ** (decimals + 2)
    unit = 10 ** decimals
    p = f"(CAST({num} AS BIGINT) * {scale})"
    d = f"CAST({den} AS BIGINT)"
    q0 = f"({p} // {d})"
    r = f"({p} % {d})"
    q = f"({q0} + CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {q0} % 2 = 1) THEN 1 ELSE 0 END)"
    txt = f"CAST({q} // {unit} AS VARCHAR) || '.' || lpad(CAST({q} % {unit} AS VARCHAR), {decimals}, '0')"
    return f"CASE WHEN {d} > 0 THEN {txt} ELSE '0.{'0' * decimals}' END"


def percent_value(num: str, den: str, decimals: int = 2) -> str:
    scale = 10 ** (decimals + 2)
    p = f"(CAST({num} AS BIGINT) * {scale})"
    d = f"CAST({den} AS BIGINT)"
    q0 = f"({p} // {d})"
    r = f"({p} % {d})"
    q = f"({q0} + CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {q0} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"CASE WHEN {d} > 0 THEN CAST({q} AS DOUBLE) / {float(10 ** decimals)} ELSE 0.0 END"
