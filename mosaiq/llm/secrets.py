"""Secret scans: known patterns, and windows of high Shannon entropy.

Everything runs inside the row with SQL functions: no shuffle, no Python, and a
document of any length is one row's work. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import anchored, load, text_or_empty

# Patterns that find secrets. Letters are spelled in both cases, since
# (?i) would differ between regular-expression engines beyond ASCII.
ASSIGN = (
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A shorter run of these two holds no match and hides none, so the least length is in the pattern.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: Per kind of base span: pattern, group whose length counts, least length.
BASE = {"assign": (ASSIGN, 1, 12), "access": (ACCESS, 0, 18), "hex": (HEX, 0, 16)}

#: Width of the sliding window, in characters.
WINDOW = 20
_HEX, _B64 = "0123456789ABCDEFabcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Per character class: candidate strings, the least entropy in bits of one of their windows, and their characters.
#: No entropy that 20 characters can have lies within 0.000001 of a threshold.
CLASSES = {"ent_hex": ("[0-9A-Fa-f]{20,}", 2.98, _HEX), "ent_b64": ("[A-Za-z0-9+/_=-]{20,}", 3.53, _B64)}
#: Allow-list: candidates that match are not secrets. Words without digits, bare numbers, UUIDs,
#: dates joined to words, the digests of empty input, counting sequences and example marks.
ALLOW = (
    "^[A-Za-z+/_=-]+$|^[0-9+/_=-]+$"
    "|^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
    "|^[a-z]+(?:[-_/][a-z]+)*[-_/][0-9]{1,4}(?:[-_/][0-9]{1,2}){0,2}$"
    "|^(?:d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$"
    "|0123456789|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]"
)
#: Candidates are scanned in blocks of so many window starts, which overlap by a window.
BLOCK = 400
KINDS = [*BASE, *CLASSES]


def _gaps_to_spans(m: str, p: str) -> str:
    """SQL: spans of the matches ``m`` between the pieces ``p`` of a text.

    Running positions are summed in blocks of 256 matches, then over blocks, so the
    cost stays near n * sqrt(n) even for a text with a million matches.
    """
    gap = f"zip_with(slice({p}, 1, size({m})), {m}, (a, b) -> struct(length(a) AS g, length(b) AS n, b AS v))"
    return f"CASE WHEN size({m}) = 0 THEN array() ELSE {gap} END"


_LOCAL = """transform(sequence(0, (size({g}) - 1) DIV 256), k -> aggregate(slice({g}, k * 256 + 1, 256),
    struct(0 AS pos, CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, v: STRING>>) AS out),
    (a, x) -> struct(a.pos + x.g + x.n AS pos, concat(a.out, array(struct(a.pos + x.g AS s, a.pos + x.g + x.n AS e, x.v AS v))) AS out)))"""
_OFFSETS = "aggregate({l}, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x.pos)))"
_JOINED = "flatten(zip_with({l}, slice({o}, 1, size({l})), (x, o) -> transform(x.out, y -> struct(y.s + o AS s, y.e + o AS e, y.v AS v))))"


def _entropy(candidate: str, letters: str) -> str:
    """SQL: the highest entropy of a window of ``candidate``, whose characters are ``letters``, by incremental counts.

    The count of every letter in the window is carried along. A window moves on by one
    character: the one that enters raises its count, the one that leaves lowers its own, and
    only their terms k*log2(k) of the running sum change.
    """
    terms = "array(" + ", ".join(repr(k * math.log2(k) if k else 0.0) + "D" for k in range(WINDOW + 1)) + ")"
    w = WINDOW
    term = lambda k: f"element_at({terms}, 1 + {k})"
    came, went = "element_at(a.n, x.new)", "element_at(a.n, x.old)"
    # low keeps the least sum of the full windows so far: the highest entropy has the least sum.
    step = f"""(a, x) -> CASE WHEN x.new = x.old THEN named_struct('n', a.n, 'g', a.g, 'low', least(a.low, a.g)) ELSE named_struct(
        'n', transform(a.n, (k, i) -> CASE i + 1 WHEN x.new THEN k + 1 WHEN x.old THEN k - 1 ELSE k END),
        'g', a.g + {term(f'{came} + 1')} - {term(came)} + CASE WHEN x.old = 0 THEN 0D ELSE {term(f'{went} - 1')} - {term(went)} END,
        'low', CASE WHEN x.old > 0 THEN least(a.low, a.g) ELSE a.low END) END"""
    moves = f"""transform(sequence(1, length(b)), i -> struct(
        instr('{letters}', substr(b, i, 1)) AS new, CASE WHEN i > {w} THEN instr('{letters}', substr(b, i - {w}, 1)) ELSE 0 END AS old))"""
    blocks = f"transform(sequence(0, greatest(length({candidate}) - {w}, 0) DIV {BLOCK}), k -> substr({candidate}, k * {BLOCK} + 1, {BLOCK} + {w} - 1))"
    low = f"aggregate({moves}, named_struct('n', array_repeat(0, {len(letters)}), 'g', 0D, 'low', 1e9D), {step}, a -> least(a.low, a.g))"
    return f"{math.log2(w)!r}D - array_min(transform({blocks}, b -> {low})) / {w}"


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and, per kind, a column ``__s_<kind>`` ARRAY<STRUCT<s, e, v>> of spans in order.

    ``v`` is the matched string. Null texts count as empty and have no spans.
    """
    df = docs.withColumn("__t", text_or_empty(text))
    patterns = {k: v[0] for k, v in BASE.items()} | {k: v[0] for k, v in CLASSES.items()}
    df = df.withColumns({f"__m_{k}": F.regexp_extract_all("__t", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    # A text is split only where it has matches.
    df = df.withColumns({f"__p_{k}": F.when(F.size(f"__m_{k}") > 0, F.split("__t", p, -1)) for k, p in patterns.items()})
    df = df.withColumns({f"__g_{k}": F.expr(_gaps_to_spans(f"__m_{k}", f"__p_{k}")) for k in patterns})
    df = df.withColumns({f"__l_{k}": F.expr(f"CASE WHEN size(__g_{k}) > 0 THEN {_LOCAL.format(g=f'__g_{k}')} ELSE array() END") for k in patterns})
    df = df.withColumns({f"__o_{k}": F.expr(_OFFSETS.format(l=f"__l_{k}")) for k in patterns})
    df = df.withColumns({f"__a_{k}": F.expr(_JOINED.format(l=f"__l_{k}", o=f"__o_{k}")) for k in patterns})
    keep = {}
    for k, (p, group, least) in BASE.items():
        length = f"length(regexp_extract(x.v, {_quoted(p)}, 1))" if group else "x.e - x.s"
        keep[f"__s_{k}"] = F.expr(f"filter(__a_{k}, x -> {length} >= {least})")
    for k, (_, least, letters) in CLASSES.items():
        keep[f"__s_{k}"] = F.expr(f"filter(__a_{k}, x -> NOT (x.v RLIKE {_quoted(ALLOW)}) AND {_entropy('x.v', letters)} >= {least}D)")
    df = df.withColumns(keep | {"__s_assign": anchored(keep["__s_assign"])})
    return df.drop(*[f"__{c}_{k}" for c in "mpgloa" for k in patterns])


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _all_spans(kinds: list[str]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    parts = ", ".join(f"transform(__s_{k}, x -> struct(x.s AS s, {rank[k]} AS r, x.e AS e, '{k}' AS k))" for k in kinds)
    return f"sort_array(concat({parts}))"


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.k, ':', x.s, ':', x.e)), ',')"


def scan_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Secrets per document: ``keep`` columns, counts per kind, digest of base spans, all spans.

    Null and empty texts give zero counts and empty lists; repeated rows give repeated
    results; other columns of ``docs`` are ignored, whatever their names.
    """
    df = with_spans(docs.select(*[F.col(c) for c in keep], F.col(text).alias("text")), "text")
    df = df.withColumns({"__base": F.expr(_all_spans(list(BASE))), "__all": F.expr(_all_spans(KINDS))})
    counts = {f"n_{k}": F.size(f"__s_{k}").cast("long") for k in KINDS}
    return df.select(
        *keep,
        *[c.alias(n) for n, c in counts.items()],
        F.sha2(F.expr(_joined("__base")), 256).alias("base_sha256"),
        F.expr(_joined("__all")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; overlapping spans become one.

    No document is dropped. Texts without secrets, null ones too, stay as they are, and
    so do all other columns, except that ``n_chars``, where there is one, follows the text.
    """
    names = docs.columns
    # The columns go along as one, so none of theirs can meet one of ours.
    df = with_spans(docs.select(F.struct("*").alias("__row"), "text"), "text")
    df = df.withColumn("__all", F.expr(_all_spans(KINDS)))
    # Merge spans by start: the last piece of acc is open until one begins behind it.
    # Blocks keep the copying of the growing list small; touching blocks are joined again when cut.
    df = df.withColumn("__cut", F.expr("""transform(sequence(0, greatest(size(__all) - 1, 0) DIV 256), k -> aggregate(slice(__all, k * 256 + 1, 256),
        CAST(array() AS ARRAY<STRUCT<s: INT, e: INT>>),
        (a, x) -> CASE WHEN size(a) > 0 AND x.s <= element_at(a, -1).e
            THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s AS s, greatest(element_at(a, -1).e, x.e) AS e)))
            ELSE concat(a, array(struct(x.s AS s, x.e AS e))) END))"""))
    # Between blocks a span may reach into the next: its starts are moved behind the end so far.
    df = df.withColumn("__run", F.expr("""aggregate(__cut, array(0), (a, x) -> concat(a, array(greatest(element_at(a, -1), coalesce(array_max(transform(x, y -> y.e)), 0)))))"""))
    df = df.withColumn("__cut", F.expr("""flatten(zip_with(__cut, slice(__run, 1, size(__cut)), (x, o) -> transform(filter(x, y -> y.e > o),
        y -> struct(greatest(y.s, o) AS s, y.e AS e, y.s < o AS joined))))"""))
    df = df.withColumn("__from", F.expr("concat(array(0), transform(__cut, x -> x.e))"))
    pieces = f"""concat_ws('', flatten(zip_with(slice(__from, 1, size(__cut)), __cut,
        (o, x) -> array(substr(__t, o + 1, x.s - o), CASE WHEN x.joined THEN '' ELSE '{mark}' END))), substr(__t, element_at(__from, -1) + 1))"""
    df = df.withColumn("__new", anchored(F.when(F.size("__cut") > 0, F.expr(pieces))))
    put = {"text": F.coalesce("__new", "__row.text")}
    if "n_chars" in names:
        put["n_chars"] = F.coalesce(F.length("__new").cast(docs.schema["n_chars"].dataType), "__row.n_chars")
    return df.select(*[put.get(c, F.col(f"__row.`{c}`")).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(load(spark, sf_dir, "documents"))


def _sql() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for rank, kind in enumerate(KINDS):
        pattern = BASE[kind][0] if kind in BASE else CLASSES[kind][0]
        parts.append(f"SELECT doc_id, rid, {rank} AS r, '{kind}' AS k, regexp_extract_all(t, {q(pattern)}) AS m, string_split_regex(t, {q(pattern)}) AS p FROM t")
    verdict = " ".join(f"WHEN k = '{k}' THEN length({f'regexp_extract(v, {q(p)}, {g})' if g else 'v'}) >= {n}" for k, (p, g, n) in BASE.items())
    verdict += " " + " ".join(f"WHEN k = '{k}' THEN NOT regexp_matches(v, {q(ALLOW)}) AND list_max(list_transform(range(1, length(v) - {WINDOW} + 2), lambda i: list_aggregate(string_split(substr(v, i, {WINDOW}), ''), 'entropy'))) >= {n}" for k, (_, n, _) in CLASSES.items())
    sums = ", ".join(f"count(*) FILTER (k = '{k}') AS n_{k}" for k in KINDS)
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
each AS (SELECT rid, r, k, unnest(m) AS v, unnest(p[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM found WHERE len(m) > 0),
placed AS (SELECT rid, r, k, v, sum(length(gap) + length(v)) OVER (PARTITION BY rid, r ORDER BY i) AS e FROM each),
spans AS (SELECT rid, r, k, CAST(e - length(v) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE CASE {verdict} END),
summed AS (SELECT rid, {sums},
    string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (r < {len(BASE)}) AS base,
    string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r) AS spans FROM spans GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN summed USING (rid)"""


ORACLE = _sql()
