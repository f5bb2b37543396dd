"""URL filters: explicit host and path rules first, then association rules mined by FP-growth.

A url becomes a set of tokens (host labels, path words, extension, query keys; numbers are one token). From
labelled urls FP-growth mines token combinations that go with bad labels. A combination becomes a
rule if at least MIN_ROWS bad urls hold it, whatever their number, if its confidence is MIN_CONFIDENCE and,
at the lower end of its 95 % interval, above the share of bad urls, and if no part of it is as confident.
Rules match by an inverted index: each rule stands under its rarest token, so a url meets only the rules of
its own tokens, and the rest of the combination is checked by set containment.

FP-growth goes breadth first here: items are in order of rising frequency, a prefix has the rest of its urls as
its conditional pattern base (equal rests are one row with counts, as in the tree), and the bases of all prefixes
of one length are counted and cut down to the next length in a job. Every url is mined with all its items.
What keeps mining small loses no rule: tokens of fewer than MIN_ROWS bad urls cannot be in a rule and go first.
Tokens that stand in the same urls (the parameters of one template) are one item, and a rule holds all of them.
If an item is in all good urls of a set, it cannot make that set, or any that holds it, more confident: such
combinations go with all that hold them. A set of confidence 1 needs no more items. What is left are sets
whose every item rules out good urls of its own; their number has no fixed bound (many items that come and go at
random in good and bad urls alike have very many), and so the time has none.

Scale: urls are reduced to distinct token sets before they meet the index (partial aggregation, so a hot
host is one row a task), and the sets that a rule blocks come back by a join whose size is measured: up to
BROADCAST_BYTES it is broadcast, else it shuffles and adaptive execution splits hot keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import stage, unstage

BROADCAST_BYTES = 4 << 20
MIN_ROWS = 20
MIN_CONFIDENCE = 0.5
#: Normal quantile of the confidence interval.
QUANTILE = 1.96


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host and its subdomains where the url's path starts with /path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: The explicit rules.
RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for urls without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), "(?s)^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "(?s)^[^/?#]*([^?#]*)", 1)


def explicit_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Sorted set of the url's tokens, each with a mark of the part that it comes from."""
    host, path = host_of(url), lower_ascii(path_of(url))
    query = lower_ascii(F.regexp_extract(after_scheme(url), r"(?s)\?([^#]*)", 1))
    number = lambda w: F.when(w.rlike("^[0-9]+$"), F.lit("#")).otherwise(w)
    parts = [
        F.transform(F.split(F.regexp_replace(host, ":[0-9]*$", ""), r"\."), lambda w: F.concat(F.lit("h:"), w)),
        F.transform(F.flatten(F.transform(F.filter(F.split(host, r"\."), lambda w: w.contains("-")), lambda w: F.split(w, "-"))), lambda w: F.concat(F.lit("w:"), w)),
        F.transform(F.split(F.regexp_replace(path, r"\.[a-z0-9]+$", ""), "[/._-]+"), lambda w: F.concat(F.lit("p:"), number(w))),
        F.transform(F.array(F.regexp_extract(path, r"\.([a-z0-9]+)$", 1)), lambda w: F.concat(F.lit("x:"), w)),
        F.transform(F.split(query, "&"), lambda w: F.concat(F.lit("q:"), F.regexp_extract(w, "^([^=]*)", 1))),
    ]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda w: F.length(w) > 2)))


def _items(baskets: DataFrame, rows: int) -> DataFrame:
    """token, item, members, freq, bad: the tokens of at least ``rows`` bad urls, with the item that stands for them."""
    each = baskets.withColumn("h", F.xxhash64("t", "bad").cast("decimal(38,0)")).select(F.explode("t").alias("token"), "bad", "h")
    tally = each.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.count_if("bad").alias("bad"), F.sum("h").alias("h")).where(F.col("bad") >= rows)
    # equal sums of hashes: the same urls
    same = tally.groupBy("freq", "bad", "h").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return same.select(F.explode("members").alias("token"), F.element_at("members", 1).alias("item"), "members", "freq", "bad")


def _lower_bound(part: Column, whole: Column) -> Column:
    """Wilson's lower bound of a share."""
    p, z = part / whole, QUANTILE
    return (p + z * z / (2 * whole) - z * F.sqrt((p * (1 - p) + z * z / (4 * whole)) / whole)) / (1 + z * z / whole)


def _may_be_rule(bad: Column, good: Column, share: float, confidence: float) -> Column:
    return (bad / (bad + good) >= confidence) & (_lower_bound(bad, bad + good) > share)


def _counted(bases: DataFrame, shorter: DataFrame, rows: int) -> DataFrame:
    """x, bad, good, below, free: the sets one item longer than ``shorter``, the prefixes that ``bases`` belong to.

    ``below`` is the confidence that a part has, of those that are known; a set is not free if an item of it
    is in all good urls of the others.
    """
    own = bases.select("x", F.explode("tail").alias("i"), "bad", "good").groupBy("x", "i").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= rows)
    own = own.select(F.array_append("x", F.col("i")).alias("x"), "bad", "good")
    parts = own.select("x", "bad", "good", F.explode(F.transform("x", lambda i: F.array_remove("x", i))).alias("part"))
    known = shorter.select(F.col("x").alias("part"), F.col("best"), F.col("free").alias("part_free"), F.col("good").alias("part_good"))
    each = parts.join(known, "part", "left").groupBy("x", "bad", "good")
    free = F.coalesce(F.bool_and("part_free"), F.lit(True)) & (F.col("good") < F.min("part_good"))
    return each.agg(F.max("best").alias("below"), free.alias("free"))


def _bases_below(bases: DataFrame, longer: DataFrame) -> DataFrame:
    """x, tail, bad, good: the conditional bases of the sets ``longer`` (x, grows), from those of their prefixes."""
    last = F.element_at("x", -1)
    kin = longer.groupBy(F.slice("x", 1, F.size("x") - 1).alias("x")).agg(F.collect_list(last).alias("all"), F.collect_list(F.when(F.col("grows"), last)).alias("growing"))
    own = bases.join(kin, "x").select("x", F.array_intersect("tail", "all").alias("tail"), "growing", "bad", "good")
    each = own.select("x", "tail", "growing", "bad", "good", F.posexplode("tail").alias("at", "i")).where(F.array_contains("growing", F.col("i")))
    return _merged(each.select(F.array_append("x", F.col("i")).alias("x"), _after("tail", "at").alias("tail"), "bad", "good"))


def _after(tail: str, at: str) -> Column:
    return F.slice(tail, F.col(at) + 2, F.size(tail))


def _merged(bases: DataFrame) -> DataFrame:
    return bases.where(F.size("tail") > 0).groupBy("x", "tail").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _grow(paths: DataFrame, items: DataFrame, share: float, rows: int, confidence: float) -> DataFrame:
    """(x, confidence): the sets of items that are rules. ``paths``: tail, bad, good (urls); ``items``: i, bad, good, free.

    Not all parts of a set are known, since none grow from a set of confidence 1 or too few bad urls, but all rules
    are, and of the parts that are as confident as a set the smallest of the most confident is a rule.
    """
    mine = F.col("bad") / (F.col("bad") + F.col("good"))
    grows = (F.col("best") < 1) & (_lower_bound(F.col("bad"), F.col("bad")) > share)
    level = items.select(F.array("i").alias("x"), "bad", "good", F.lit(0.0).alias("below"), "free")
    roots = items.withColumn("best", mine).where(F.col("free") & grows).select("i")
    bases = _merged(paths.select("tail", "bad", "good", F.posexplode("tail").alias("at", "i")).join(roots, "i").select(F.array("i").alias("x"), _after("tail", "at").alias("tail"), "bad", "good"))
    found, tables = [], []
    while True:
        level = stage(level.withColumn("best", F.greatest("below", mine)), "url-level")
        own = F.col("free") & (mine > F.col("below")) & _may_be_rule(F.col("bad"), F.col("good"), share, confidence)
        found.append(level.where(own).select("x", mine.alias("confidence")))
        if tables:
            bases = _bases_below(bases, level.where("free").select("x", grows.alias("grows")))
        bases = stage(bases, "url-bases")
        tables += [level, bases]
        if bases.isEmpty():
            break
        level = _counted(bases, level, rows)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    out = stage(out, "url-found")
    for t in tables:
        unstage(t)
    part = out.select(F.col("x").alias("part"), F.col("confidence").alias("part_confidence"), F.col("x")[0].alias("i"))
    held = (F.size("part") < F.size("x")) & (F.col("part_confidence") >= F.col("confidence")) & (F.size(F.array_except("part", "x")) == 0)
    return out.join(out.select("x", "confidence", F.explode("x").alias("i")).join(part, "i").where(held).select("x").distinct(), "x", "left_anti")


def mine_rules(labelled: DataFrame, rows: int = MIN_ROWS, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, key, confidence) from rows of url and bad (boolean); nulls in either are left out.

    ``key`` is the rarest of the rule's tokens. Without bad rows there are no rules. Repeated rows each count;
    a url of any length is one set of tokens.
    """
    spark = labelled.sparkSession
    baskets = stage(labelled.where("url is not null and bad is not null").select(tokens_of(F.col("url")).alias("t"), "bad"), "url-baskets")
    n, n_bad = baskets.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    items = stage(_items(baskets, rows), "url-items")
    if n_bad < rows or items.isEmpty():
        return spark.createDataFrame([], "tokens array<string>, key string, confidence double")
    good = F.col("freq") - F.col("bad")
    numbers = stage(items.where("token = item").orderBy("freq", "item").select("item", "freq", "bad", good.alias("good"), (good < n - n_bad).alias("free"), F.monotonically_increasing_id().alias("i")), "url-numbers")
    own = baskets.withColumn("id", F.monotonically_increasing_id()).select("id", "bad", F.explode("t").alias("item"))
    own = own.join(numbers.where("free").select("item", "i"), "item").groupBy("id", "bad").agg(F.array_sort(F.collect_list("i")).alias("tail"))
    paths = stage(own.groupBy("tail").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")), "url-paths")
    rules = _grow(paths, numbers, n_bad / n, rows, confidence)
    whole = rules.select("x", "confidence", F.explode("x").alias("i")).join(numbers.select("i", "item", "freq"), "i").join(items.where("token = item").select("item", "members"), "item")
    whole = whole.groupBy("x", "confidence").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("tokens"), F.min(F.struct("freq", "item")).alias("least"))
    out = stage(whole.select("tokens", F.col("least.item").alias("key"), "confidence"), "url-rules")
    for t in (baskets, items, numbers, paths):
        unstage(t)
    return out


def blocked_sets(sets: DataFrame, mined: DataFrame) -> DataFrame:
    """Of the token sets (column t) those that hold all tokens of a rule, once each."""
    index = mined.select(F.col("key").alias("token"), F.col("tokens").alias("rule"))
    return sets.select("t", F.explode("t").alias("token")).join(index, "token").where(F.size(F.array_except("rule", "t")) == 0).select("t").distinct()


def judge(pages: DataFrame, mined: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; a url that no rule fits is blocked by a mined rule or allowed.

    A null url, or one without ``://``, has empty host and path and is allowed. Repeated rows are each judged,
    urls of any length whole. An empty table gives an empty result; other columns are ignored.
    """
    url = F.col("url").cast("string")
    own = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("t"))
    bad = stage(blocked_sets(own.select("t").distinct(), mined), "url-blocked")
    measured = bad.agg(F.sum(F.octet_length(F.array_join("t", " ")) + 32).alias("n")).first()
    bad = bad.select(F.col("t").alias("blocked"))
    if (measured.n or 0) <= BROADCAST_BYTES:
        bad = F.broadcast(bad)
    joined = own.join(bad, F.col("t") == F.col("blocked"), "left")
    rule = explicit_rule(F.col("host"), F.col("path"), rules)
    verdict = F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")
    for r in rules:
        verdict = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(verdict)
    return joined.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def labelled_urls(spark: SparkSession, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls with labels: the number that ends a page's path names the document the page shows."""
    doc = F.regexp_extract(path_of(F.col("url")), r"([0-9]+)(?:\.[a-z]+|/)?$", 1).try_cast("long")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    return pages.select("url", doc.alias("doc_id")).join(marks, "doc_id").select("url", "bad")
