"""Quality rules: text statistics as Spark expressions, and a decision list learnt from labelled ones.

Sequential covering grows one conjunction of thresholds at a time by information gain on a growing part of the
labelled rows, prunes it on the other part, and goes on with the rows that no rule covers yet. Each step is one
grouped count over the labelled rows; the driver sees a row for each statistic and bin. The list becomes an
ordered ``CASE WHEN``.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.tables import fresh, scope, written

#: White space between words, and the characters that count as symbols.
BREAK, WORD, SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
WINDOW = 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _statistics(docs: DataFrame, text_col: str, names: dict[str, str]) -> DataFrame:
    """``docs`` with all its columns, and the statistics under the names given.

    They come out of a generator of one row, through which no later filter is pushed: below it, a filter would
    have whole chains of arrays put in place of each name.
    """
    q = fresh(docs, "_q")
    own = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    one = docs.select(*own, text.alias(f"{q}text"), F.array_remove(F.split(text, BREAK), "").alias(f"{q}words"))
    lines = F.filter(F.split(f"{q}text", "\n"), lambda x: x.rlike(WORD))
    two = one.select(*own, f"{q}text", f"{q}words", lines.alias(f"{q}lines"), F.transform(f"{q}words", lambda w: F.xxhash64(w)).alias(f"{q}hash"))
    following = ", ".join(f"get({q}hash, i + {j})" for j in range(1, WINDOW))
    windows = F.expr(f"transform(slice({q}hash, 1, greatest(size({q}hash) - {WINDOW - 1}, 0)), (x, i) -> xxhash64(x, {following}))")
    three = two.select(*own, f"{q}text", f"{q}words", f"{q}lines", windows.alias(f"{q}windows"), F.expr(f"cast(ceil(log2(size({q}words) + 2)) as int)").alias(f"{q}bits"))
    # hash above, position below
    placed = F.expr(f"case when size({q}windows) > size(array_distinct({q}windows)) then sort_array(transform({q}windows, (x, i) -> shiftleft(shiftright(x, {q}bits), {q}bits) | cast(i as bigint))) end")
    four = three.select(*own, f"{q}text", f"{q}words", f"{q}lines", f"{q}bits", placed.alias(f"{q}placed"))
    same = f"shiftright(x, {q}bits) = shiftright(get({q}placed, i {{}}), {q}bits)"
    repeated = F.expr(f"sort_array(transform(filter({q}placed, (x, i) -> coalesce({same.format('- 1')}, false) or coalesce({same.format('+ 1')}, false)), x -> x & (shiftleft(1L, {q}bits) - 1L)))")
    five = four.select(*own, f"{q}text", f"{q}words", f"{q}lines", repeated.alias(f"{q}repeated"))
    covered = F.expr(f"coalesce(aggregate(transform({q}repeated, (x, i) -> least({WINDOW}L, coalesce(get({q}repeated, i + 1) - x, {WINDOW}L))), 0L, (s, x) -> s + x), 0L)")
    values = {
        "n_words": F.size(f"{q}words"),
        "word_chars": F.length(F.array_join(f"{q}words", "")),
        "n_symbols": F.regexp_count(f"{q}text", F.lit(SYMBOL)),
        "n_lines": F.size(F.split(f"{q}text", "\n")),
        "n_dup_lines": F.size(f"{q}lines") - F.size(F.array_distinct(f"{q}lines")),
        "n_repeat_words": covered,
    }
    return five.select(*own, F.inline(F.array(F.struct(*(values[n].cast("bigint").alias(c) for n, c in names.items())))))


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each whole text.

    Null counts as the empty text, whose statistics are all 0 but n_lines, which is 1. Given columns stay, but one that
    bears the name of a statistic (with ``prefix`` before it) is replaced. Repeated rows stay, each with its statistics; an
    empty table gives none. Windows are compared by 64-bit hashes first; in a text where two agree, by hashes that
    share a number with the position, sorted, so that a text of n words takes n log n steps however it repeats; a very
    long text needs a few longs for each word, in one task.
    """
    q = fresh(docs, "_s")
    names = {n: q + n for n in (*BASE, "n_lines")}
    found = _statistics(docs, text_col, names)
    replaced = {(prefix + n).lower() for n in names}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in replaced]
    return found.select(*kept, *(F.col(own).alias(prefix + n) for n, own in names.items()))


def base_failed(prefix: str = "") -> Column:
    """The fixed rule: fewer than 10 words, or over a fifth of the words in repeated windows."""
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def measures(prefix: str = "") -> dict[str, Column]:
    """What the rules put thresholds on; each is defined for the empty text."""
    c = {n: F.col(prefix + n).cast("double") for n in (*BASE, "n_lines")}
    words = F.greatest(c["n_words"], F.lit(1.0))
    return {
        "n_words": c["n_words"],
        "word_length": c["word_chars"] / words,
        "symbol_share": c["n_symbols"] / words,
        "dup_line_share": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)),
        "repeat_share": c["n_repeat_words"] / words,
        "words_per_line": c["n_words"] / F.greatest(c["n_lines"], F.lit(1.0)),
    }


class Condition(NamedTuple):
    measure: str
    at_least: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.measure] >= self.threshold if self.at_least else values[self.measure] < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


class Rule(NamedTuple):
    """A conjunction that rejects, with the share of bad rows among the labelled ones it covers, and the number of those."""

    conditions: tuple[Condition, ...]
    precision: float
    support: int

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(values)
        return out

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.conditions))}  ({self.precision:.3f} of {self.support})"


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """Number of the first rule that covers the row, from 1; 0 if none does."""
    values, out = measures(prefix), None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(values), k) if out is None else out.when(rule.column(values), k)
    return F.lit(0) if out is None else out.otherwise(0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 40_000, bins: int = 32, max_rules: int = 6, max_conditions: int = 3, least_precision: float = 0.95, least_support: int = 5) -> list[Rule]:
    """A decision list that finds rows labelled 0 (bad) among at most about ``max_rows`` labelled texts, those of lowest hash of the id.

    A rule is kept if ``least_precision`` of the rows it covers are bad, on the pruning third and on the others alike,
    and ``least_support`` bad rows or more are covered, a fifth of them at least on the pruning third. Without labelled
    rows, or rows of both kinds, the list is empty and keeps everything. Null labels and ids are left out; an id that has
    several labels counts with one of them; rows that repeat are counted each. Of conditions that gain the same, the one
    of the earlier measure and lower threshold is taken.
    """
    own = labels.select(F.col(f"`{id_col}`").alias("_q_id"), (F.col(f"`{label_col}`") == 0).alias("_q_bad")).filter("_q_id is not null and _q_bad is not null").dropDuplicates(["_q_id"])
    n = own.count()
    if n > max_rows:
        own = own.filter(F.pmod(F.xxhash64("_q_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    texts = docs.select(F.col(f"`{id_col}`").alias("_q_id"), F.col(f"`{text_col}`").alias("text"))
    # every third row of either kind prunes; about max_rows ids and flags, a bound that holds for any table
    place = F.row_number().over(Window.partitionBy("_q_bad").orderBy(F.xxhash64("_q_id", F.lit(7)), "_q_id"))
    own = own.select("_q_id", "_q_bad", (place % 3 > 0).alias("_q_grow"))
    known = with_statistics(texts.join(F.broadcast(own), "_q_id"))
    values = measures()
    with scope(docs.sparkSession):
        rows = written(known.select(F.col("_q_grow").alias("grow"), F.col("_q_bad").alias("bad"), *(v.alias(k) for k, v in values.items())))
        names = list(values)
        shares = [k / bins for k in range(1, bins)]
        found = rows.agg(*(F.percentile_approx(k, shares, 10_000).alias(k) for k in names), *(F.percentile_approx(F.when(F.col("bad"), F.col(k)), shares, 10_000).alias(f"{k}_bad") for k in names)).first()
        edges = {k: sorted({*(found[k] or []), *(found[f"{k}_bad"] or [])}) for k in names}
        if not any(edges.values()):
            return []
        at = F.array(*(_bin(k, edges[k]) for k in names))
        binned = written(rows.select("grow", "bad", *names, at.alias("at")))
        columns = {k: F.col(k) for k in names}
        rules: list[Rule] = []
        while len(rules) < max_rules:
            left = binned
            for rule in rules:
                left = left.filter(~rule.column(columns))
            conditions: list[Condition] = []
            while len(conditions) < max_conditions:
                covered = left.filter("grow")
                for c in conditions:
                    covered = covered.filter(c.column(columns))
                best = _best(covered, names, edges)
                if best is None or best in conditions:
                    break
                # a tighter threshold takes the place of a looser one on the same side
                conditions = [c for c in conditions if c[:2] != best[:2]] + [best]
            if not conditions:
                break
            # pruned to the beginning of it that does best on the other part; least conditions among equals
            tests = [Rule(tuple(conditions[:k]), 0, 0).column(columns) for k in range(1, len(conditions) + 1)]
            part = lambda name, test: (F.count_if(test & F.col("bad")).alias(f"bad_{name}"), F.count_if(test).alias(f"all_{name}"))
            seen = left.agg(*(c for k, t in enumerate(tests) for c in (*part(f"prune{k}", t & ~F.col("grow")), *part(f"grow{k}", t & F.col("grow"))))).first()
            worth = [(2 * seen[f"bad_prune{k}"] - seen[f"all_prune{k}"]) / max(1, seen[f"all_prune{k}"]) for k in range(len(tests))]
            k = max(range(len(tests)), key=lambda j: (round(worth[j], 3), -j))
            bad, every = ([seen[f"{x}_{part}{k}"] for part in ("prune", "grow")] for x in ("bad", "all"))
            rule = Rule(tuple(conditions[: k + 1]), sum(bad) / max(1, sum(every)), sum(every))
            if min(b - least_precision * n for b, n in zip(bad, every, strict=True)) < 0 or sum(bad) < least_support or 5 * bad[0] < least_support:
                break
            rules.append(rule)
        return rules


def _bin(name: str, edges: list[float]) -> Column:
    """How many edges are at or below the value."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(name))) if edges else F.lit(0)


def _best(covered: DataFrame, names: list[str], edges: dict[str, list[float]]) -> Condition | None:
    """The threshold of most information gain: bad rows covered times what their share's logarithm gains."""
    spread = covered.select("bad", F.posexplode("at").alias("measure", "bin"))
    counts: dict[int, dict[int, tuple[int, int]]] = {}
    for r in spread.groupBy("measure", "bin").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n")).collect():
        counts.setdefault(r.measure, {})[r.bin] = (r.bad, r.n)
    best, most = None, 1e-9
    for m, own in sorted(counts.items()):
        bad, n = (sum(x[j] for x in own.values()) for j in (0, 1))
        if not bad or bad == n:
            continue
        before, low_bad, low_n = math.log2(bad / n), 0, 0
        for b, edge in enumerate(edges[names[m]], 1):
            x = own.get(b - 1, (0, 0))
            low_bad, low_n = low_bad + x[0], low_n + x[1]
            for at_least, p, q in ((True, bad - low_bad, n - low_n), (False, low_bad, low_n)):
                if p and q < n and (gain := p * (math.log2(p / q) - before)) > most:
                    best, most = Condition(names[m], at_least, edge), gain
    return best


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, base_failed, rule (the first that covers the row, else 0) and kept.

    Columns of these names are replaced, all others stay. Each row has a verdict: null and empty texts fail the
    fixed rule, repeated rows are judged alike, an empty table gives no rows. A measure that equals a threshold
    counts as at least it. Filters on the result don't make the statistics dearer.
    """
    stats = with_statistics(docs, text_col)
    ruled = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return ruled.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Rows that neither the fixed rule nor the list rejects, with all their columns as they were, whatever their names.

    Null and empty texts go (they have fewer than 10 words), repeated rows stay or go together, an empty table stays empty.
    """
    q = fresh(docs, "_k")
    found = _statistics(docs, text_col, {n: q + n for n in (*BASE, "n_lines")})
    return found.filter(~base_failed(q) & (verdict(rules, q) == 0)).select(*(F.col(f"`{c}`") for c in docs.columns))
