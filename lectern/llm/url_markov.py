"""URL filter: character language models of accepted and rejected URLs.

Only DataFrame functions are used.  Each class has a variable-order Markov
model of characters: the probability after the longest known context, smoothed
with that of the next shorter one (Witten-Bell).  A URL is blocked when its
log-likelihood difference, divided by its length, is over a threshold that is
calibrated on labelled URLs which the models did not see.  Host and path rules
come first; the URLs that they decide are the labelled rows, unless others are
given, so that the models carry what the rules say over to the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import materialize

ORDER, ALPHABET, PAD = 4, 64, "^"
#: Contexts of an order up to which their table is sent to all tasks; a larger one is joined by context, with the same result.
BROADCAST_CONTEXTS = 100_000

#: The default rules: host, beginning of the path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host, A-Z in lower case, and the path; both empty without it."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits (longest first; among equals the first by text) and its verdict, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def labelled_by_rules(pages: DataFrame, *, url_col: str = "url", rules=RULES) -> DataFrame:
    """Labelled URLs (url, accepted): the distinct ones that a rule decides."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(url_col).alias("url"), host.alias("_host"), path.alias("_path"))
    verdict = rule_of(F.col("_host"), F.col("_path"), rules)[1]
    return rows.select("url", (verdict == "allow").alias("accepted")).where("accepted IS NOT NULL").distinct()


def _text(host: Column, path: Column) -> Column:
    """What the models read: host without a leading www., then the path, A-Z in lower case."""
    return F.concat(F.regexp_replace(host, "^www\\.", ""), F.translate(path, _UPPER, _LOWER))


def _positions(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A row for each character: keys, c, and the contexts c1 to cK before it.

    The text is split into characters once and is not carried along, so that
    the work is linear in its length.
    """
    split = df.where(F.length(text) > 0).select(*keys, F.split(F.concat(F.lit(PAD * ORDER), F.col(text)), "").alias("_c"))

    def at(i: Column) -> Column:
        before = [F.get("_c", i - k) for k in range(1, ORDER + 1)]
        return F.struct(F.get("_c", i).alias("c"), *[F.concat(*reversed(before[:k])).alias(f"c{k}") for k in range(1, ORDER + 1)])

    found = split.select(*keys, F.explode(F.transform(F.sequence(F.lit(ORDER), F.size("_c") - 1), at)).alias("_p"))
    return found.select(*keys, "_p.*")


@dataclass
class UrlModel:
    """Per order a table (ctx, n and t of both classes, counts by character), and the threshold."""

    tables: list[DataFrame]
    threshold: float


def _probabilities(at: DataFrame, tables: list[DataFrame]) -> Column | DataFrame:
    """``at`` with p_good and p_bad, the smoothed probabilities of its characters."""
    for which in ("good", "bad"):
        at = at.withColumn(f"p_{which}", F.lit(1.0 / ALPHABET))
    for k, table in enumerate(tables, 1):
        at = at.join(table.withColumnRenamed("ctx", f"c{k}"), f"c{k}", "left")
        for which in ("good", "bad"):
            n, t, p = F.col(f"n_{which}"), F.col(f"t_{which}"), F.col(f"p_{which}")
            seen = F.coalesce(F.col(f"m_{which}")[F.col("c")], F.lit(0))
            at = at.withColumn(f"p_{which}", F.when(n > 0, (seen + t * p) / (n + t)).otherwise(p))
        at = at.drop(*[f"{x}_{w}" for x in "ntm" for w in ("good", "bad")])
    return at


def score(df: DataFrame, keys: list[str], text: str, tables: list[DataFrame]) -> DataFrame:
    """keys and score: the log-likelihood difference (rejected less accepted) per character.

    ``keys`` must tell the rows apart. A row with the empty text is left out.
    """
    at = _probabilities(_positions(df, keys, text), tables)
    return at.groupBy(*keys).agg(F.avg(F.log(F.col("p_bad") / F.col("p_good"))).alias("score"))


def fit(labelled: DataFrame, *, false_reject: float = 0.005) -> UrlModel:
    """Fit both models and the threshold on labelled URLs (url, accepted).

    All rows are used.  A quarter is kept from the models to calibrate: of its
    accepted URLs ``false_reject`` are over a score, of its rejected ones
    ``false_reject`` are under another, and the threshold is halfway between
    them, or the first where the classes overlap; it is not below 0.  Where
    that quarter lacks a class there is no evidence, and nothing is blocked.
    Rows with a null in either column are left out.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND accepted IS NOT NULL").select(_text(host, path).alias("text"), "accepted").distinct()
    rows = materialize(rows, "labelled-urls")
    aside = F.pmod(F.xxhash64("text", F.lit(2)), F.lit(4)) == 0
    at = materialize(_positions(rows.where(~aside), ["accepted"], "text"), "labelled-characters")
    tables = []
    for k in range(1, ORDER + 1):
        counts = at.groupBy(F.col(f"c{k}").alias("ctx"), "accepted", "c").count()
        both = []
        for which, own in (("good", "accepted"), ("bad", "NOT accepted")):
            mine = F.expr(own)
            chars = F.map_from_entries(F.collect_list(F.when(mine, F.struct("c", "count"))))
            both += [F.coalesce(F.sum(F.when(mine, F.col("count"))), F.lit(0)).alias(f"n_{which}"), F.count_if(mine).alias(f"t_{which}"), chars.alias(f"m_{which}")]
        table = materialize(counts.groupBy("ctx").agg(*both), f"contexts-{k}")
        tables.append(F.broadcast(table) if table.count() <= BROADCAST_CONTEXTS else table)
    held = score(rows.where(aside).withColumn("row", F.xxhash64("text", "accepted")), ["row", "accepted"], "text", tables)
    ends = held.agg(
        F.percentile_approx(F.when(F.col("accepted"), F.col("score")), 1 - false_reject, 10_000), F.percentile_approx(F.when(~F.col("accepted"), F.col("score")), false_reject, 10_000)
    ).first()
    good, bad = ends
    if good is None or bad is None:
        return UrlModel(tables, float("inf"))
    return UrlModel(tables, max(0.0, (good + bad) / 2 if bad > good else good))


def judge(pages: DataFrame, model: UrlModel, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per input row: id, host, path, rule, score, verdict (allow or block).

    The rule's verdict holds where a rule fits.  A null url, one without
    ``://`` and one with an empty host and path have no evidence, score 0, and
    are allowed unless a rule fits.  Equal URLs, by a 128-bit digest, are scored
    once.  Ids may be null or repeat; other columns play no part.
    """
    host, path = host_and_path(F.col(url_col))
    text = _text(F.col("host"), F.col("path"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumns({"a": F.xxhash64(text), "b": F.xxhash64(text, F.lit(1))})
    texts = rows.groupBy("a", "b").agg(F.first(text).alias("text"))
    scored = materialize(score(texts, ["a", "b"], "text", model.tables), "url-scores")  # so that the join with it is a plain one
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(scored, ["a", "b"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    own = F.when(F.col("score") > model.threshold, F.lit("block")).otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, own).alias("verdict"))
