"""URL filters: host rules, then a path-template tree for each host.

URLs are first reduced to counts of (host, path shape), so that a host with any share of all pages is a few template
rows; all its rows are grouped sums, none meets the others in one task. Level by level, to the paths' full depth, the
tree turns segments into wildcards where a branch has many rare children. Branches that differ in one segment are
merged where their labelled rates agree; a branch without labels differs from no rate and joins its labelled siblings
where these hold half of the URLs at least, so that labels don't speak for far more URLs than they cover. A template is
rejected when its labelled purity is high, smoothed by its parent's purity, that by the host's, that by even odds; a
node most of whose URLs have no label counts as even odds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, written

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A branch with more children than FANOUT turns those with under 1 / FANOUT of its URLs into '*'.
FANOUT = 32
#: Templates are rejected at this share of blocked labels, smoothed by SMOOTH labels with the share of the node above.
REJECT, SMOOTH = 0.8, 2.0
#: The share of URLs with labels from which a node's labels speak for those without.
COVER = 0.5
#: Branches are merged up to this many standard errors from their common rate.
SIMILAR = 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first :// and /, ?, # or the end, A-Z lower-cased. Path: from there to ?, # or the end.

    Both are empty for null and where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the url's or a parent of it and whose path starts the url's: (rule, verdict)."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def shape(path: Column) -> Column:
    """All segments, with numbers, digests and dates generalised by their looks."""
    segments = F.split(F.regexp_replace(path, r"^/", ""), "/", -1)
    return F.transform(
        segments,
        lambda s: F.when(s.rlike(r"^[0-9]+$"), "{n}").when(s.rlike(r"^[0-9a-fA-F]{8,}$|^[0-9a-fA-F-]{32,}$"), "{x}").when(s.rlike(r"^[0-9]+\.[A-Za-z]{1,5}$"), F.concat(F.lit("{n}"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s),
    )


def generalised(shapes: DataFrame) -> DataFrame:
    """shapes (host, shape, ..., urls), one row a shape: adds its template, with wildcards for rare children.

    Only branches with more than FANOUT shapes below them can have so many children; the loop ends when none is left."""
    rest = [c for c in shapes.columns if c not in ("host", "shape")]
    todo, done, level = shapes.withColumn("template", F.col("shape")), None, 1
    while True:
        todo = todo.withColumn("above", F.concat_ws("/", F.slice("template", 1, level - 1))).withColumn("own", F.try_element_at("template", F.lit(level)))
        wide = todo.where("own is not null").groupBy("host", "above").agg(F.count("*").alias("k"), F.sum("urls").alias("whole")).where(f"k > {FANOUT}")
        todo = todo.join(wide, ["host", "above"], "left")
        settled = todo.where("k is null or own is null").select("host", "shape", *rest, "template")
        done = settled if done is None else done.unionByName(settled)
        todo = written(todo.where("k is not null and own is not null"), "url-branches")
        if todo.isEmpty():
            return done
        children = todo.groupBy("host", "above", "own").agg(F.sum("urls").alias("n"))
        fans = children.groupBy("host", "above").agg(F.count("*").alias("fan"))
        rare = children.join(fans.where(f"fan > {FANOUT}"), ["host", "above"]).select("host", "above", "own", "n")
        wild = F.concat(F.slice("template", 1, level - 1), F.array(F.lit("*")), F.slice("template", F.lit(level + 1), F.size("template")))
        todo = todo.join(rare, ["host", "above", "own"], "left").withColumn("template", F.when(F.col("n") * FANOUT < F.col("whole"), wild).otherwise(F.col("template")))
        todo, done, level = written(todo.select("host", "shape", *rest, "template"), "url-tree"), written(done, "url-settled"), level + 1


def merged(rates: DataFrame) -> DataFrame:
    """rates (host, template, b, a, u: blocked, allowed and all URLs): (host, template, into) of branches that merge with
    others that differ in one segment; of several such segments the first."""
    # only templates of a length that the host has twice can differ in one segment
    sized = rates.withColumn("size", F.size("template"))
    twice = sized.groupBy("host", "size").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    masks = sized.join(twice, ["host", "size"]).select("host", "template", "b", "a", "u", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("pos"))
    rest = F.expr("struct(xxhash64(slice(template, 1, pos - 1)), xxhash64(slice(template, pos + 1, size)))")
    masks = written(masks.withColumn("mask", F.struct("size", "pos", rest.alias("rest"))), "url-masks")
    # labelled branches whose rate is within SIMILAR standard errors of their common one
    labelled, n = masks.where("a + b > 0"), F.col("a") + F.col("b")
    common = labelled.groupBy("host", "mask").agg((F.sum("b") / F.sum(n)).alias("p"))
    error = F.sqrt(F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-9)) / n)
    alike = labelled.join(common, ["host", "mask"]).where(F.abs(F.col("b") / n - F.col("p")) <= SIMILAR * error).select("host", "template", "mask", "pos", "a", "b", "u")
    pools = alike.groupBy("host", "mask").agg(F.count("*").alias("branches"), F.sum(n).alias("labels"), F.sum("u").alias("urls"))
    bare = masks.where("a + b = 0").select("host", "template", "mask", "pos", "a", "b", "u")
    joined = bare.groupBy("host", "mask").agg(F.count("*").alias("bare"), F.sum("u").alias("bare_urls"))
    pools = pools.join(joined, ["host", "mask"], "left").withColumn("covered", F.col("labels") >= COVER * (F.col("urls") + F.coalesce("bare_urls", F.lit(0))))
    in_pool = alike.join(pools.where("branches > 1 or (covered and bare > 0)").select("host", "mask"), ["host", "mask"])
    join_in = bare.join(pools.where("covered").select("host", "mask"), ["host", "mask"])
    first = in_pool.unionByName(join_in).groupBy("host", "template").agg(F.min("pos").alias("pos"))
    into = F.expr("concat(slice(template, 1, pos - 1), array('*'), slice(template, pos + 1, size(template)))")
    return first.select("host", "template", into.alias("into"))


def _smoothed(b: str, n: str, u: str, above: Column) -> Column:
    """Purity smoothed by the node above; even odds where labels cover too few URLs."""
    return F.when(F.col(n) >= COVER * F.col(u), (F.col(b) + SMOOTH * above) / (F.col(n) + SMOOTH)).otherwise(0.5)


def templates(labelled: DataFrame) -> DataFrame:
    """labelled (host, shape, blocked, allowed, urls), one row a shape: adds the template, its purity and whether it is
    rejected."""
    t = written(generalised(labelled), "url-templates")
    rates = written(t.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.sum("urls").alias("u")), "url-rates")
    t = t.join(written(merged(rates), "url-merged"), ["host", "template"], "left").withColumn("template", F.coalesce("into", "template")).drop("into")
    final = t.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("n"), F.sum("urls").alias("u"))
    final = written(final.withColumn("above", F.slice("template", F.lit(1), F.size("template") - 1)), "url-final")

    def sums(*by):
        level = "hp"[len(by) - 1]
        return final.groupBy(*by).agg(*(F.sum(c).alias(f"{level}_{c}") for c in "bnu"))

    final = final.join(sums("host", "above"), ["host", "above"]).join(sums("host"), "host")
    host = _smoothed("h_b", "h_n", "h_u", F.lit(0.5))
    parent = _smoothed("p_b", "p_n", "p_u", host)
    final = final.withColumn("purity", (F.col("b") + SMOOTH * parent) / (F.col("n") + SMOOTH)).select("host", "template", "purity", (F.col("purity") >= REJECT).alias("rejected"))
    return t.join(final, ["host", "template"])


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of pages.

    The rules' verdicts are the labels of the templates; a URL without a rule is blocked if its template is rejected,
    else allowed. purity: the smoothed share of blocked labels that decided. Null urls and those without :// have an empty host and path.
    Repeated rows stay; other columns are ignored; an empty table gives an empty one."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("given", verdict).withColumn("shape", shape(F.col("path")))
    counts = urls.groupBy("host", "shape").agg(F.count_if(F.col("given") == "block").alias("blocked"), F.count_if(F.col("given") == "allow").alias("allowed"), F.count("*").alias("urls"))
    known = written(templates(written(counts, "url-shapes")).select("host", "shape", F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"), "purity", "rejected"), "url-known")
    found = urls.join(known, ["host", "shape"])
    return found.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "purity")
