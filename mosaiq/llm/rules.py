"""Quality rules: a ledger of measurements and failure bits, policies over it, ablations.

Every rule is evaluated once per document and its outcome kept as one bit of
``fail_bits``. The ledger is written, and policies are masks over its bits, so another
policy, or the question what a rule costs, never reads a text again. All of it is SQL
functions inside the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import anchored, load, stored, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Letters in upper case, as far as Latin-1 has them.
UPPER = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; it is never null."""

    name: str
    fails: str


#: In order of their bits, which never change; new rules go at the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 5 * word_chars"),
    Rule("shouting", "100 * n_upper > 50 * word_chars"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule("word_length", "word_chars > 12 * n_words OR word_chars < 2 * n_words"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]


@dataclass(frozen=True)
class Policy:
    """A document is kept unless a bit of ``hard`` is set or more than ``most`` bits of ``soft`` are."""

    version: int
    hard: int
    soft: int = 0
    most: int = 0

    def rejects(self, bits: str = "fail_bits") -> str:
        return f"(({bits} & {self.hard}) <> 0 OR bit_count({bits} & {self.soft}) > {self.most})"


POLICIES = {
    1: Policy(1, BASE),
    2: Policy(2, BASE | BIT["symbols"] | BIT["shouting"] | BIT["repeated_lines"], BIT["word_length"], 1),
    3: Policy(3, BASE | BIT["symbols"] | BIT["shouting"] | BIT["repeated_lines"], BIT["word_length"]),
}
CURRENT = 3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of MEASURES behind a ``__`` each.

    A 64-bit hash finds the texts in which a window of three words may come again; in those
    the words of windows whose hashes meet are compared.
    """
    df = docs.withColumn("__t", text_or_empty())
    df = df.withColumns({
        "__w": F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)),
        "__lines": F.expr(r"filter(split(__t, '\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"),
        "__n_symbols": F.length("__t") - F.length(F.translate("__t", SYMBOLS, "")),
        "__n_upper": F.length("__t") - F.length(F.translate("__t", UPPER, "")),
        "__word_chars": F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")),
    })
    df = df.withColumns({
        "__h": F.expr("CASE WHEN size(__w) < 3 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size(__w) - 3), i -> xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2))) END"),
        "__n_words": F.size("__w"),
        "__n_lines": F.size("__lines"),
        "__n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
    })
    # Only texts in which a window comes again are sorted.
    df = df.withColumn("__o", F.expr("CASE WHEN size(array_distinct(__h)) = size(__h) THEN array() ELSE sort_array(transform(__h, (x, i) -> struct(x AS h, concat_ws(' ', get(__w, i), get(__w, i + 1), get(__w, i + 2)) AS w, i AS i))) END"))
    df = df.withColumn("__at", F.expr("""sort_array(filter(transform(__o, (x, k) -> CASE WHEN x.w = get(__o, k - 1).w OR x.w = get(__o, k + 1).w THEN x.i ELSE -1 END), x -> x >= 0))"""))
    df = df.withColumn("__n_repeat_words", F.expr("aggregate(zip_with(__at, slice(__at, 2, size(__at)), (a, b) -> CASE WHEN b IS NULL THEN 3 ELSE least(3, b - a) END), 0, (a, x) -> a + x)"))
    return df.withColumn("__n_words", anchored(F.col("__n_words"))).drop("__t", "__w", "__lines", "__h", "__o", "__at")


def _bits(measure: str = "{}") -> str:
    """SQL: the failure bits, from measurements named as ``measure`` says."""
    import re

    named = lambda s: re.sub(rf"\b({'|'.join(MEASURES)})\b", lambda m: measure.format(m[1]), s)
    return " + ".join(f"CASE WHEN {named(r.fails)} THEN {BIT[r.name]} ELSE 0 END" for r in RULES)


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep``, every measurement (long) and ``fail_bits`` (long), written to the shared folder.

    Null texts count as empty: no words, so they fail ``few_words``. Repeated rows are
    measured each; other columns are ignored.
    """
    df = _measured(docs.select(*keep, "text"))
    df = df.select(*keep, *[F.col(f"__{m}").cast("long").alias(m) for m in MEASURES])
    return stored(df.withColumn("fail_bits", F.expr(_bits()).cast("long")), "ledger")


def apply_policy(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """A ledger with ``policy`` and ``kept`` by the policy of that version."""
    return book.withColumns({"policy": F.lit(version), "kept": ~F.expr(POLICIES[version].rejects())})


def ablations(book: DataFrame, version: int = CURRENT, by: tuple[str, ...] = ()) -> DataFrame:
    """Per rule (and group): documents that fail it, and documents kept with and without it.

    The ledger is counted by its bits, 2 ** rules patterns at most, before the shuffle; every
    policy is then a mask over those patterns. The result has a row per rule and group,
    whatever the number of documents. An empty ledger gives zeros if ``by`` is empty, else no row.
    """
    p = POLICIES[version]
    patterns = book.groupBy(*by, "fail_bits").agg(F.count(F.lit(1)).alias("__n"))
    total = lambda condition: F.coalesce(F.sum(F.when(F.expr(condition), F.col("__n"))), F.lit(0))
    sums: list[Column] = [total(f"NOT {p.rejects()}").alias("kept")]
    for r in RULES:
        without = Policy(version, p.hard & ~BIT[r.name], p.soft & ~BIT[r.name], p.most)
        sums += [total(f"(fail_bits & {BIT[r.name]}) <> 0").alias(f"f_{r.name}"), total(f"NOT {without.rejects()}").alias(f"k_{r.name}")]
    totals = patterns.groupBy(*by).agg(total("true").alias("n_docs"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).cast("long").alias("bit"), F.col(f"f_{r.name}").alias("n_failed"), F.col(f"k_{r.name}").alias("n_kept_without")) for r in RULES]))
    return totals.select(*by, "n_docs", F.col("kept").alias("n_kept"), rows.alias("x")).select(*by, "n_docs", "n_kept", "x.*")


def keep_good(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, unchanged, all columns."""
    # The columns go along as one, so none of theirs can meet one of ours.
    df = _measured(docs.select(F.struct("*").alias("__row"), "text"))
    df = df.withColumn("__fail_bits", F.expr(_bits("__{}")).cast("long"))
    return df.filter(~F.expr(POLICIES[version].rejects("__fail_bits"))).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(ledger(load(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(f"(fail_bits & {BASE}) <> 0").alias("base_failed"), "kept", "n_lines", "n_upper", "fail_bits")


def query_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger(load(spark, sf_dir, "documents")))


_LEDGER = rf"""
t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM w WHERE len(w) >= 3),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
hit AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) AS r(k) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS BIGINT) AS n_upper FROM w LEFT JOIN hit USING (rid)),
b AS (SELECT *, CAST({_bits()} AS BIGINT) AS fail_bits FROM m)"""

ORACLE = f"""WITH {_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT {POLICIES[CURRENT].rejects()} AS kept, n_lines, n_upper, fail_bits FROM b"""

ORACLE_ABLATIONS = f"WITH {_LEDGER}\n" + " UNION ALL ".join(
    f"SELECT '{r.name}' AS rule, CAST({BIT[r.name]} AS BIGINT) AS bit, count(*) AS n_docs, count(*) FILTER (NOT {POLICIES[CURRENT].rejects()}) AS n_kept, count(*) FILTER (fail_bits & {BIT[r.name]} <> 0) AS n_failed,"
    f" count(*) FILTER (NOT {Policy(0, POLICIES[CURRENT].hard & ~BIT[r.name], POLICIES[CURRENT].soft & ~BIT[r.name], POLICIES[CURRENT].most).rejects()}) AS n_kept_without FROM b"
    for r in RULES
)
