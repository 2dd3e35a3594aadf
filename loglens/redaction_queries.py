"""Redaction held against SQL. DuckDB's expressions know no lookaround and only ASCII words, so a rule that looks around takes
the characters beside its match along: matches are marked, the text is cut at the marks, and what lies between two of them is
judged and replaced. Characters that two matches share need a second pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.functions import redact

Query = Callable[[SparkSession, str], DataFrame]
WORDS = r"\p{L}\p{M}\p{N}_"
SPACE = r"\x{9}-\x{D}\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: An address begins and ends with a word character.
EMAIL = rf"[{WORDS}][{WORDS}.+-]*@[{WORDS}-]+\.[{WORDS}.-]*[{WORDS}]"
MARK = "chr(1)"
_P1 = r"(?:\+?1[ .-]?)?\(?[2-9]\p{Nd}{2}\)?[ .-]\p{Nd}{3}[ .-]\p{Nd}{4}"
_P2 = r"\+[2-9]\p{Nd}{0,2}[ .-]?\p{Nd}{1,4}(?:[ .-]?\p{Nd}{2,4}){2,4}"
_LUHN = "(len(regexp_replace(p, '[^0-9]', '', 'g')) > 0 AND list_sum(list_transform(string_split(reverse(regexp_replace(p, '[^0-9]', '', 'g')), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN TRY_CAST(c AS INT) WHEN TRY_CAST(c AS INT) > 4 THEN 2 * TRY_CAST(c AS INT) - 9 ELSE 2 * TRY_CAST(c AS INT) END)) % 10 = 0)"
_HAS = "regexp_matches(p, '{}')".format
HOME = "/home/me"


def _q(s: str) -> str:
    return s.replace("'", "''")


#: What is marked already is passed over as a whole, and gets an empty mark behind it.
_DONE = r"(\x01[^\x01]*\x01)|"


def _beside(left: str, body: str, right: str) -> tuple[str, str, int]:
    return f"{_DONE}({left})({body})({right})", r"'\1\2' || chr(1) || '\3' || chr(1) || '\4'", 2


#: kind -> (pattern, what marks its match, passes), what a match must be, replacement; kinds with a part share their rule.
AROUND = {
    "home_path": (_beside("", HOME, rf"$|[/\\{SPACE}]"), "TRUE", "~"),
    "user_path": (_beside("", rf"(?:/Users|/home)/[^/{SPACE}]+", ""), f"NOT regexp_matches(regexp_replace(p, '^(?:/Users|/home)/', ''), '^Shared($|[^{WORDS}])')", "~"),
    "user_path:drive": (_beside(rf"^|[^{WORDS}\x01]", rf"[A-Za-z]:\\Users\\[^\\{SPACE}]+", ""), "TRUE", "~"),
    "ssn": (_beside(r"^|[^\p{Nd}\x01-]", r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}", r"$|[^\p{Nd}-]"), "TRUE", "[redacted:ssn]"),
    "card": (_beside(r"^|[^\p{Nd}\x01-]", r"\p{Nd}(?:[ -]?\p{Nd}){12,18}", r"$|[^\p{Nd}-]"), _LUHN, "[redacted:card]"),
    "phone": ((rf"{_DONE}(^|[^{WORDS}+\x01])({_P1})($|[^{WORDS}])|(^|[^{WORDS}\x01])({_P2})($|[^{WORDS}])", r"'\1\2\5' || chr(1) || '\3\6' || chr(1) || '\4\7'", 2), "TRUE", "[phone]"),
    "password_like": (
        (rf"([^{SPACE}\x01]+)", r"chr(1) || '\1' || chr(1)", 1),
        f"length(p) BETWEEN 8 AND 64 AND {_HAS('[a-z]')} AND {_HAS('[A-Z]')} AND {_HAS(r'\p{Nd}')} AND {_HAS(f'[^{WORDS}{SPACE}]')} AND NOT {_HAS(r'[/<>`()\[\]{}]')}", "[redacted]",
    ),
    "long_secret": (_beside(rf"^|[^{WORDS}/.\x01-]", "[A-Za-z0-9+_-]{32,}={0,2}", rf"$|[^{WORDS}/]"), f"{_HAS('[0-9]')} AND {_HAS('[A-Z]')}", "[redacted:long-string]"),
    "long_secret:hex": (_beside(rf"^|[^{WORDS}\x01]", "[A-Fa-f0-9]{32,}", f"$|[^{WORDS}]"), "TRUE", "[redacted:long-string]"),
    "long_secret:slash": (_beside(rf"^|[^{WORDS}/.\x01-]", "[A-Za-z0-9+/_-]{48,}={0,2}", rf"$|[^{WORDS}/]"), _HAS("[0-9]"), "[redacted:long-string]"),
}


def scrubbed(source: str, home: bool = False) -> str:
    """CTEs behind `source` (columns, text), a relation: r holds them with text redacted and a count n_kind per rule."""
    steps, at, seen = [], source, []
    every = (["home_path"] if home else []) + [k for k, *_ in redact.RULES]
    for kind in [x for k in every for x in [k, *(a for a in AROUND if a.startswith(f"{k}:"))]]:
        own, name = kind.split(":")[0], f"s{len(steps)}"
        count = f"n_{own} + {{}} AS n_{own}" if own in seen else f"{{}} AS n_{own}"
        drop = f"EXCLUDE (text{f', n_{own}' if own in seen else ''})"
        seen.append(own)
        if kind in AROUND:
            (rx, marked, passes), ok, new = AROUND[kind]
            out = "text"
            for _ in range(passes):
                out = f"regexp_replace({out}, '{_q(rx)}', {marked}, 'g')"
            cut = f"(SELECT *, string_split({out}, {MARK}) AS parts FROM {at})"
            text = f"array_to_string(list_transform(parts, lambda p, k: CASE WHEN k % 2 = 0 AND length(p) > 0 AND {ok} THEN '{new}' ELSE p END), '')"
            steps.append(f"{name} AS (SELECT * {drop.replace('text', 'text, parts')}, {text} AS text, {count.format(f'len(list_filter(parts, lambda p, k: k % 2 = 0 AND length(p) > 0 AND {ok}))')} FROM {cut})")
        else:
            pattern, new = next((p, n) for k, p, n in redact.RULES if k == kind)
            rx, new = _q(EMAIL if kind == "email" else pattern), new.replace("$1", r"\1").replace("$2", r"\2")
            n = f"len(list_filter(regexp_extract_all(text, '{rx}'), lambda m: regexp_replace(m, '{rx}', '{new}') <> m))"
            steps.append(f"{name} AS (SELECT * {drop}, regexp_replace(text, '{rx}', '{new}', 'g') AS text, {count.format(n)} FROM {at})")
        at = name
    return ",\n".join([*steps, f"r AS (SELECT * FROM {at})"])


#: What is put behind each document: everything that a rule finds, and its neighbours that it must leave.
PLANTED = [
    f"{HOME}/a {HOME}l/b {HOME}", "call (415) 555-2671 now, 1-415-555-2671", "ssn 078-05-1120 078-05-1121, 078-05-11201", "card 4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111",
    "/home/ann/x /Users/Shared/y /Users/Sharedx/z", r"C:\Users\bob\f xC:\Users\eve", "Passw0rd!x Passw0rd/x Passw0rd-y", "deadbeef" * 4 + " " + "deadbeef" * 3, "A1b2" * 9 + " " + "A1b2" * 7 + " x." + "A1b2" * 9,
    "a1/b2_" * 9 + "==", "+44 20 7946 0958 then +44", "415-555-2671 415-555-2672 415-555-26733", "sk-" + "ant-" + "a1" * 9, "é.ä@mail.example.com, x@y", "Authorization: bearer " + "t0ken." * 4, "nothing here",
]
_CASE = "CASE doc_id % {n} {whens} END".format(n=len(PLANTED), whens=" ".join(f"WHEN {k} THEN '{{{k}}}'" for k in range(len(PLANTED))))
_KINDS = ["home_path", *[k for k, *_ in redact.RULES]]


def redact_planted(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents with something to redact behind each: the redacted text, and which rules changed how much."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    planted = F.get(F.array(*[F.lit(p) for p in PLANTED]), (F.col("doc_id") % len(PLANTED)).cast("int"))
    rows = docs.select("doc_id", F.concat("text", F.lit("\n"), planted, F.lit(" end")).alias("text"))
    done = rows.select("doc_id", F.inline(F.array(redact.scrubbed(F.col("text"), HOME))))
    counted = F.concat_ws(",", *[F.when(F.get("n", F.lit(i)) > 0, F.concat(F.lit(f"{k}="), F.get("n", F.lit(i)))) for i, k in enumerate(redact.kinds(HOME))])
    return done.select("doc_id", "text", counted.alias("counts"))


_PLANTED_SQL = _CASE.format(*[_q(p) for p in PLANTED])
QUERIES: dict[str, Query] = {"redact_planted": redact_planted}
ORACLES = {
    "redact_planted": f"""WITH x AS (SELECT doc_id, text || chr(10) || {_PLANTED_SQL} || ' end' AS text FROM documents), {scrubbed('x', home=True)}
SELECT doc_id, text, concat_ws(',', {', '.join(f"CASE WHEN n_{k} > 0 THEN '{k}=' || n_{k} END" for k in _KINDS)}) AS counts FROM r""",
    "redact_full": f"WITH x AS (SELECT doc_id, text FROM documents), {scrubbed('x')} SELECT doc_id, text FROM r",
    "redact_cards": f"WITH x AS (SELECT doc_id, text FROM documents), {scrubbed('x')} SELECT doc_id, CAST(n_card AS BIGINT) AS cards FROM r WHERE n_card > 0",
}


def counts_oracle(prompts: str) -> str:
    """Counts per rule over prompts p, given the CTEs that make them."""
    kinds = ", ".join(f"('{k}', (SELECT sum(n_{k}) FROM r))" for k in _KINDS[1:])
    return f"{prompts}, x AS (SELECT text FROM p), {scrubbed('x')} SELECT kind, CAST(n AS BIGINT) AS n FROM (VALUES {kinds}) AS v(kind, n) WHERE n > 0"
