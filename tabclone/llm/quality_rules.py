"""Quality rules: document statistics and a learned decision list, all in SQL expressions.

Sequential covering finds conjunctions of thresholds that hold for documents labelled bad: each grows on two thirds of a labelled
sample by the condition of the highest information gain, is pruned from its end on the other third, and is taken if it is
precise enough on both; what it covers is set aside, and the next one is sought.  The list is applied as one ordered CASE.
Training reads at most LABELLED rows (those with the smallest hashes); only their statistics reach the driver.  Statistics and
verdicts are computed on every whole text, without a shuffle but for texts over WHOLE bytes: their arrays of words would not fit
an executor, so they are cut into slices at white space and at line ends, whose words, windows and lines are rows (windows and
lines are equal there by 128 bits of SHA-256).

Defined cases: a null or empty text has no words and fails the base rule; repeated rows and null ids are judged row by row; no
labels, or of one class only, give an empty list that rejects nothing; an empty table gives an empty one; other columns pass
through judge() untouched, whatever their names, since all statistics live in one struct column, for which one of its name gives way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

#: Labelled rows that training may read, the share of a rule's rows that must be bad, and the fewest bad rows of a rule.
LABELLED, PRECISION, LEAST = 4000, 0.97, 5
#: Conditions of a rule and thresholds tried for each feature.
CONDITIONS, THRESHOLDS = 4, 48
#: What separates words, and what counts as a symbol.
SPACE = "\\u0020\\u0009\\u000a\\u000b\\u000c\\u000d"
SPACES, SYMBOLS, MARKS = "[\\\\x20\\\\x09-\\\\x0D]", "#*$%&|<>", "!?"
WINDOW = 5
#: Bytes of a text from which on it is cut into slices, and the characters of a slice, about.
WHOLE, SLICE = 1 << 20, 1 << 20
FEATURES = ("words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "line_words")


def _bind(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _words(t: str) -> str:
    return f"filter(split({t}, '{SPACES}'), x -> x <> '')"


def _lines(t: str) -> str:
    return f"filter(split({t}, '\\n'), x -> trim(BOTH '{SPACE}' FROM x) <> '')"


def _kept(t: str, chars: str) -> str:
    # a pattern of what is rarer, so that it matches seldom
    return f"char_length(regexp_replace({t}, '[^{chars}]+', ''))"


def _upper(t: str) -> str:
    return f"char_length({t}) - char_length(regexp_replace({t}, '[A-ZÀ-ÖØ-Þ]', ''))"


def statistics(text: str) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks and n_lines of a text column."""
    t = f"coalesce({text}, '')"
    words = _words(t)
    at = f"sequence(0, size(w) - {WINDOW})"
    hashes, told = (", ".join(f"{x}[i + {k}]" for k in range(WINDOW)) for x in "hw")
    # of pairs (v, i) in order: the positions i whose v occurs again
    again = lambda pairs: _bind(f"sort_array({pairs})", "s", "filter(transform(s, (x, j) -> CASE WHEN x.v = (CASE WHEN j > 0 THEN s[j - 1].v END) OR x.v = (CASE WHEN j < size(s) - 1 THEN s[j + 1].v END) THEN x.i END), x -> x IS NOT NULL)")
    # windows whose hash occurs again are compared by their words, which hold no space and so may be joined by spaces
    found = _bind(again("transform(v, (x, i) -> struct(x AS v, i AS i))"), "f", again(f"transform(f, i -> struct(concat_ws(' ', {told}) AS v, i AS i))"))
    # each covers WINDOW words, less what the next one covers
    covered = _bind(f"sort_array({found})", "p", f"CASE WHEN size(p) = 0 THEN 0 ELSE {WINDOW} + aggregate(transform(p, (x, k) -> CASE WHEN k > 0 THEN least({WINDOW}, x - p[k - 1]) ELSE 0 END), 0, (a, x) -> a + x) END")
    repeats = _bind(f"transform({at}, i -> xxhash64({hashes}))", "v", f"CASE WHEN size(array_distinct(v)) = size(v) THEN 0 ELSE {covered} END")
    repeats = f"CASE WHEN size(w) < {WINDOW} THEN 0 ELSE {_bind('transform(w, x -> xxhash64(x))', 'h', repeats)} END"
    fields = {
        "n_words": "size(w)", "word_chars": "char_length(array_join(w, ''))", "n_symbols": _kept(t, SYMBOLS), "n_dup_lines": "size(l) - size(array_distinct(l))",
        "n_repeat_words": repeats, "n_upper": _upper(t), "n_marks": _kept(t, MARKS), "n_lines": "size(l)",
    }
    made = "named_struct(" + ", ".join(f"'{k}', CAST({v} AS bigint)" for k, v in fields.items()) + ")"
    return F.expr(_bind(words, "w", _bind(_lines(t), "l", made)))


def _slices(text: str, mark: str) -> str:
    """The slices of a text, each but the first from a character that matches mark on: the first such one of each SLICE characters."""
    at = f"transform(sequence(0, cast((char_length({text}) - 1) DIV {SLICE} AS int)), k -> CASE WHEN k = 0 THEN 1 ELSE k * {SLICE} + nullif(regexp_instr(substring({text}, k * {SLICE} + 1, {SLICE}), '{mark}'), 0) END)"
    return _bind(f"filter({at}, x -> x IS NOT NULL)", "b", f"transform(b, (x, j) -> substring({text}, x, CASE WHEN j < size(b) - 1 THEN b[j + 1] - x ELSE char_length({text}) END))")


def _sliced_statistics(texts: DataFrame) -> DataFrame:
    """id and stats, the struct of statistics(), of texts (id and text, written) of any length."""
    parts = texts.select("id", F.posexplode(F.expr(_slices("text", SPACES))).alias("k", "s"))
    parts = base.cut(parts.select("id", "k", *(F.expr(v).alias(n) for n, v in (("w", _words("s")), ("n_symbols", _kept("s", SYMBOLS)), ("n_upper", _upper("s")), ("n_marks", _kept("s", MARKS))))), "quality-slices")
    sums = parts.groupBy("id").agg(F.sum(F.size("w")).alias("n_words"), F.sum(F.expr("char_length(array_join(w, ''))")).alias("word_chars"), *(F.sum(c).alias(c) for c in ("n_symbols", "n_upper", "n_marks")))
    # windows go over into the next slices, each of which has a word at least
    order = Window.partitionBy("id").orderBy("k")
    heads = parts.where("size(w) > 0").select("id", "k", F.size("w").alias("n"), F.slice("w", 1, WINDOW - 1).alias("head"))
    heads = heads.select("id", "k", (F.sum("n").over(order) - F.col("n")).alias("at"), F.slice(F.flatten(F.collect_list("head").over(order.rowsBetween(1, WINDOW - 1))), 1, WINDOW - 1).alias("next"))
    met = parts.select("id", "k", "w").join(heads, ["id", "k"]).select("id", "at", F.concat("w", "next").alias("w")).where(f"size(w) >= {WINDOW}")
    told = F.expr(f"transform(sequence(0, size(w) - {WINDOW}), i -> concat_ws(' ', {', '.join(f'w[i + {k}]' for k in range(WINDOW))}))")
    windows = met.select("id", "at", F.posexplode(told).alias("i", "told")).select("id", (F.col("at") + F.col("i")).alias("pos"), base.text_key("told").alias("key"))
    again = windows.withColumn("n", F.count("*").over(Window.partitionBy("id", "key"))).where("n > 1")
    # each covers WINDOW words, less what the one before it covers
    new = F.least(F.lit(WINDOW), F.coalesce(F.col("pos") - F.lag("pos").over(Window.partitionBy("id").orderBy("pos")), F.lit(WINDOW)))
    repeats = again.select("id", new.alias("new")).groupBy("id").agg(F.sum("new").alias("n_repeat_words"))
    lines = texts.select("id", F.explode(F.expr(_slices("text", "\\n"))).alias("s")).select("id", F.explode(F.expr(_lines("s"))).alias("line"))
    lines = lines.groupBy("id", base.text_key("line").alias("key")).count().groupBy("id").agg(F.sum("count").alias("n_lines"), (F.sum("count") - F.count("*")).alias("n_dup_lines"))
    found = sums.join(repeats, "id", "left").join(lines, "id", "left")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
    return base.cut(found.select("id", F.struct(*(F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names)).alias("stats")), "quality-long")


def with_statistics(rows: DataFrame, text: str) -> DataFrame:
    """rows with one more column, stats, of the texts that the expression text gives; those over WHOLE bytes are written first."""
    long = base.cut(rows.where(F.expr(f"octet_length({text}) > {WHOLE}")).select(F.monotonically_increasing_id().alias("_long"), "*"), "quality-texts")
    if long.isEmpty():
        return rows.withColumn("stats", statistics(text))
    told = _sliced_statistics(long.select(F.col("_long").alias("id"), F.expr(text).cast("string").alias("text")))
    others = rows.where(F.expr(f"coalesce(octet_length({text}), 0) <= {WHOLE}")).withColumn("stats", statistics(text))
    met = long.select(F.col("_long").alias("id"), F.struct(*rows.columns).alias("held")).join(F.broadcast(told), "id")
    return others.unionByName(met.select(*(F.col(f"held.{c}").alias(c) for c in rows.columns), "stats"))


def base_failed(s: str = "stats") -> Column:
    return F.expr(f"{s}.n_words < 10 OR 100 * {s}.n_repeat_words > 20 * {s}.n_words")


def features(s: str = "stats") -> dict[str, Column]:
    share = lambda a, b: F.expr(f"CAST({s}.{a} AS double) / greatest({s}.{b}, 1)")
    made = (F.expr(f"CAST({s}.n_words AS double)"), share("word_chars", "n_words"), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "word_chars"), share("n_marks", "word_chars"), share("n_words", "n_lines"))
    return dict(zip(FEATURES, made, strict=True))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self, s: str) -> Column:
        x = features(s)[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(bad: list[dict], good: list[dict]) -> Rule:
    rule: Rule = ()
    while len(rule) < CONDITIONS and good and bad:
        best, chosen = 1e-9, None
        for f in FEATURES:
            values = sorted({r[f] for r in bad} | {r[f] for r in good})
            mids = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
            if len(mids) > THRESHOLDS:  # even steps through the sorted middles, and their two ends
                mids = [mids[i * (len(mids) - 1) // (THRESHOLDS - 1)] for i in range(THRESHOLDS)]
            for t in mids:
                p, n = sum(r[f] > t for r in bad), sum(r[f] > t for r in good)
                for above, x, y in ((True, p, n), (False, len(bad) - p, len(good) - n)):
                    if (g := _gain(x, y, len(bad), len(good))) > best:
                        best, chosen = g, Condition(f, above, t)
        if chosen is None:
            break
        rule += (chosen,)
        bad, good = [r for r in bad if chosen.holds(r)], [r for r in good if chosen.holds(r)]
    return rule


def _prune(rule: Rule, bad: list[dict], good: list[dict]) -> Rule:
    def worth(k: int) -> float:
        p, n = sum(covers(rule[:k], r) for r in bad), sum(covers(rule[:k], r) for r in good)
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(rows: list[dict]) -> list[Rule]:
    """The decision list for rows with the features, bad (a truth value) and held (rows for pruning)."""
    parts = [[r for r in rows if r["bad"] == b and r["held"] == h] for b in (True, False) for h in (False, True)]
    bad, bad_held, good, good_held = parts
    found: list[Rule] = []
    while len(bad) >= LEAST and good and (rule := _prune(_grow(bad, good), bad_held, good_held)):
        p, n = (sum(covers(rule, r) for r in x) for x in (bad + bad_held, good + good_held))
        if p < LEAST or p < PRECISION * (p + n):
            break
        found.append(rule)
        bad, bad_held, good, good_held = ([r for r in x if not covers(rule, r)] for x in (bad, bad_held, good, good_held))
    return found


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> list[Rule]:
    """The list learnt from the labelled documents with the smallest hashes, LABELLED at most, that pass the base rule."""
    some = labels.select(F.col(doc_id).alias("id"), F.col(quality).alias("quality")).where("id IS NOT NULL AND quality IS NOT NULL")
    some = some.withColumn("h", F.xxhash64("id")).orderBy("h", "quality").limit(LABELLED)
    # LABELLED rows at most are broadcast; base_failed is a column and no filter, which the optimizer would push below the join and so compute for every document
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id").select("id", "h", "quality", "text")
    rows = with_statistics(found, "text").select("h", (F.col("quality") == 0).alias("bad"), base_failed().alias("failed"), *(c.alias(k) for k, c in features().items())).orderBy("failed", "h", *FEATURES).limit(2 * LABELLED).collect()
    return learn([r.asDict() | {"held": r["h"] // 8 % 3 == 0} for r in rows if not r["failed"]])


def verdict(rules: list[Rule], s: str = "stats") -> Column:
    """The number of the first rule that holds, as one ordered conditional; null if none does."""
    out = None
    for i, rule in enumerate(rules):
        held = rule[0].column(s)
        for c in rule[1:]:
            held &= c.column(s)
        out = F.when(held, F.lit(i)) if out is None else out.when(held, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", into: str = "quality_rules") -> DataFrame:
    """docs with one more column: a struct of the statistics, base_failed, rule (the number of the rule that holds) and kept."""
    inner = with_statistics(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), f"row.`{text}`")
    told = F.struct("stats.*", base_failed().alias("base_failed"), verdict(rules).alias("rule"), (~base_failed() & verdict(rules).isNull()).alias("kept"))
    return inner.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() != into.lower()), told.alias(into))


def describe(rules: list[Rule]) -> list[str]:
    return [" AND ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.4g}" for c in rule) for rule in rules]
