"""URL filters: rules by host and path, and templates learned from the pages that rules label.

Each host's paths form a tree. Segments with too few pages to tell them from each other are variable and
become a wildcard (their extension is kept). Stretches where a node's paths go one way, or where no segment has pages enough to be a
section, are found for all nodes at once from counts of (place, segment), and passed in one step, so that rounds are as many as a path has
branchings, not segments. The other branches are compared with each other: those whose subtrees have
the same shape are pooled, those without labelled pages with the labelled ones, and a branch whose share of blocked pages among the
labelled ones, or of its subtree's main shape, differs significantly from the rest of its pool leaves it. What is left is
merged. The leaves are templates; those whose smoothed labelled purity is high are rejected, with their pages without
a label. As a rule labels whole branches, the evidence of a generalised segment is the number of its labelled values, not of pages:
one blocked section says nothing about its merged neighbours, many do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfold.llm.common import written

#: (action, host and path). Fixed values of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (ASCII lower-cased) and path; both empty for a null url and one without ``://``."""
    after = f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END"
    return F.expr(f"translate(regexp_extract({after}, r'^[^/?#]*', 0), '{UPPER}', '{LOWER}')"), F.expr(f"regexp_extract({after}, r'^[^/?#]*([^?#]*)', 1)")


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(action, rule) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _chi2(a: Column, not_a: Column, b: Column, not_b: Column) -> Column:
    """The chi-squared statistic of two rows of counts; 0 where one kind or one row has none."""
    a, not_a, b, not_b = (x.cast("double") for x in (a, not_a, b, not_b))
    margins = (a + not_a) * (b + not_b) * (a + b) * (not_a + not_b)
    return F.when(margins > 0, (a + not_a + b + not_b) * F.pow(a * not_b - not_a * b, F.lit(2)) / margins).otherwise(0.0)


NODE = ["host", "_t"]


def _merged(shapes: DataFrame, chi2: float) -> DataFrame:
    """host, _t, _seg, _name of the branches that are sections: a name of its own, or that of the branches that it is merged
    with; null if it is merged with the values. ``shapes``: host, _t, _seg, _shape with their pages n, blocked b and allowed a.

    A branch of n pages can't differ from another of that size if 2n < chi2, and is taken for a value, not a section."""
    branch = shapes.groupBy(*NODE, "_seg").agg(*(F.sum(c).alias(c) for c in "bna"), F.max(F.struct("n", "_shape")).alias("top")).where(F.col("n") * 2 >= chi2)
    branch = branch.select(*NODE, "_seg", "b", "a", "n", F.col("top.n").alias("m"), F.col("top._shape").alias("_shape"))
    branch = written(branch.withColumn("lean", F.when(F.col("b") > F.col("a"), 1).when(F.col("a") > 0, 0)), "sections")
    # Branches without labels go with the labelled ones, if these are all of one kind.
    leans = branch.groupBy(*NODE, "_shape").agg(F.when(F.min("lean") == F.max("lean"), F.min("lean")).otherwise(2).alias("only"))
    pool = [*NODE, "_shape", "lean"]
    left = written(branch.join(leans, [*NODE, "_shape"]).withColumn("lean", F.coalesce("lean", "only")).drop("only"), "pooled")
    alone = []
    while True:
        rest = left.groupBy(*pool).agg(*(F.sum(c).alias("all_" + c) for c in "banm"), F.count("*").alias("k"), F.min("_seg").alias("first"))
        other = {c: F.col("all_" + c) - F.col(c) for c in "banm"}
        by_label = _chi2(F.col("b"), F.col("a"), other["b"], other["a"])
        by_shape = _chi2(F.col("m"), F.col("n") - F.col("m"), other["m"], other["n"] - other["m"])
        both = written(left.join(written(rest, "pools"), pool).withColumn("x", F.greatest(by_label, by_shape)), "tested")
        differ = not both.where(F.col("x") >= chi2).isEmpty()
        if differ:
            # What differs most leaves first: others may only differ from it.
            most = both.groupBy(*pool).agg(F.max("x").alias("most"))
            both = written(both.join(written(most, "most"), pool).withColumn("out", (F.col("x") >= chi2) & (F.col("x") * 2 >= F.col("most"))), "compared")
            alone.append(both.where("out").select(*NODE, "_seg", F.col("_seg").alias("_name")))
        else:
            # The only pool of a node goes with its values.
            pools = both.where("k > 1").groupBy(*NODE).agg((F.count_distinct("_shape", "lean") > 1).alias("several"))
            name = F.when(F.col("k") == 1, F.col("_seg")).when(F.col("several"), F.concat(F.lit("{"), "first", F.lit("}")))
            kept = both.join(written(pools, "several"), NODE, "left").select(*NODE, "_seg", name.alias("_name"))
            return reduce(DataFrame.unionByName, [*alone, kept])
        left = both.where("not out").select(*left.columns)


def _shape(segments: Column) -> Column:
    """Segments as numbers (0) or words (a), with their extensions."""
    words = F.regexp_replace(segments, r"(?<=^|/)[\p{L}\p{N}_-]*[\p{L}_-][\p{L}\p{N}_-]*(?=[/.]|$)", "a")
    return F.regexp_replace(words, r"(?<=^|/)[0-9]+(?=[/.]|$)", "0")


def _extension(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"\.[A-Za-z]{1,5}$", 0))


def _stretches(open_: DataFrame, chi2: float) -> DataFrame:
    """host, _t, pages, ways: of each node, its pages, and what is decided about the next places of its paths without looking at branches:
    true for a segment that all of them share, false for a wildcard. A wildcard that tells pages apart, by their extension or as some end
    there, is the last one. The others are no sections whatever they are merged with: 2n < chi2."""
    each = open_.select(*NODE, F.posexplode("_rest").alias("at", "segment"))
    counts = each.groupBy(*NODE, "at", "segment").agg(F.count("*").alias("n"))
    ends = F.count_distinct(_extension(F.col("segment")))
    places = counts.groupBy(*NODE, "at").agg(F.sum("n").alias("n"), F.max("n").alias("top"), ends.alias("ends"))
    listed = places.groupBy(*NODE).agg(F.array_sort(F.collect_list(F.struct("at", "n", "top", "ends"))).alias("p")).withColumn("pages", F.get("p", F.lit(0))["n"])
    same = lambda x: x["top"] == F.col("pages")
    free = lambda x: x["top"] * 2 < chi2
    whole = lambda x: (x["n"] == F.col("pages")) & (same(x) | (free(x) & (x["ends"] == 1)))
    # The places before the first that isn't whole, and that one too if it is a wildcard.
    stop = F.coalesce(F.get(F.filter(F.transform("p", lambda x, i: F.when(~whole(x), i)), lambda i: i.isNotNull()), F.lit(0)), F.size("p"))
    last = F.coalesce(free(F.get("p", stop)), F.lit(False)).cast("int")
    return listed.select(*NODE, "pages", F.transform(F.slice("p", F.lit(1), stop + last), same).alias("ways"), (last == 0).alias("decide"))


def _passed(rows: DataFrame, ways: Column, wild: Column | None = None) -> DataFrame:
    """rows with the first of their segments named as ``ways`` says (true: as they are), as many as it has; all of them, as
    wildcards, where ``wild`` holds."""
    n = F.when(wild, F.size("_rest")).otherwise(F.least(F.size(ways), F.size("_rest")))
    taken = F.slice("_rest", F.lit(1), n)
    kept = lambda i: F.coalesce(~wild & F.get(ways, i), F.lit(False))
    names = F.transform(taken, lambda x, i: F.when(kept(i), x).otherwise(_extension(x)))
    value = F.transform(taken, lambda x, i: F.when(~kept(i), F.struct((i + F.col("_at")).cast("int").alias("place"), x.alias("segment"))))
    return (
        rows.withColumn("_names", names).withColumn("values", F.concat("values", F.filter(value, lambda x: x.isNotNull()))).withColumn("_t", F.concat("_t", F.when(n > 0, F.lit("/")).otherwise(""), F.array_join("_names", "/")))
        .withColumn("_at", F.col("_at") + n).withColumn("_rest", F.slice("_rest", n + 1, F.greatest(F.size("_rest") - n, F.lit(0)))).drop("_names")
    )


def templates(pages: DataFrame, chi2: float = 6.63) -> DataFrame:
    """Adds ``template`` and ``values`` to rows with ``host``, ``path`` and ``label`` (1 blocked, 0 allowed, else null).

    ``values``: the generalised segments (place, segment) of the row's path. ``chi2``: the statistic from which two branches
    differ (6.63: one in a hundred, one degree of freedom). The tree is as deep as the paths; nodes of so few pages that they have no sections
    are followed to the end at once."""
    none = F.array().cast("array<struct<place:int,segment:string>>")
    cur = written(pages.select(*pages.columns, F.split(F.regexp_replace("path", "^/", ""), "/").alias("_rest"), F.lit(0).alias("_at"), F.lit("").alias("_t"), none.alias("values")), "paths")
    columns, done, round_ = cur.columns, [], 0
    finished = lambda rows: rows.select(*pages.columns, F.col("_t").alias("template"), "values")
    while True:
        done.append(finished(cur.where(F.size("_rest") == 0)))
        open_ = cur.where(F.size("_rest") > 0)
        # Written, so that the join can split the rows of a host that has a third of all.
        ways = written(_stretches(open_, chi2), "stretches")
        if ways.isEmpty():
            return reduce(DataFrame.unionByName, done)
        few = F.col("pages") * 2 < chi2
        gone = written(_passed(open_.join(ways, NODE), F.col("ways"), few), f"passed{round_}")
        left = gone.where((F.size("_rest") > 0) & F.col("decide"))
        cur = gone.where((F.size("_rest") == 0) | ~F.col("decide")).select(*columns)
        after = F.array_join(F.slice("_rest", F.lit(2), F.greatest(F.size("_rest") - 1, F.lit(0))), "/")
        left = left.withColumn("_seg", F.get("_rest", F.lit(0))).withColumn("_shape", _shape(after))
        shapes = written(left.groupBy(*NODE, "_seg", "_shape").agg(F.count_if(F.col("label") == 1).alias("b"), F.count_if(F.col("label") == 0).alias("a"), F.count("*").alias("n")), "shapes")
        if not shapes.isEmpty():
            named = left.join(written(_merged(shapes, chi2), "branches"), [*NODE, "_seg"], "left")
            value = F.struct(F.col("_at").alias("place"), F.col("_seg").alias("segment"))
            named = named.withColumn("values", F.when(F.col("_name") == F.col("_seg"), F.col("values")).otherwise(F.concat("values", F.array(value))))
            named = named.withColumn("_t", F.concat("_t", F.lit("/"), F.coalesce("_name", _extension(F.col("_seg"))))).withColumn("_at", F.col("_at") + 1)
            named = named.withColumn("_rest", F.slice("_rest", F.lit(2), F.greatest(F.size("_rest") - 1, F.lit(0))))
            cur = written(cur.unionByName(named.select(*columns)), f"after{round_}")
        round_ += 1


def purities(rows: DataFrame, strength: float, prior: float) -> DataFrame:
    """host, template, purity: of each template, ``(blocked + strength * prior) / (blocked + allowed + strength)``.

    Both count distinct values of a generalised segment: the one that has the fewest of those that have values without any label,
    since what is said about these pages is carried over from labelled values; else the one that has the most. Where nothing
    is generalised, they count pages."""
    counted = rows.select("host", "template", "label", F.explode_outer("values").alias("v"))
    counted = counted.select("host", "template", "label", F.coalesce(F.col("v.place"), F.lit(-1)).alias("place"), F.col("v.segment").alias("segment"))
    value = counted.groupBy("host", "template", "place", "segment").agg(F.count_if(F.col("label") == 1).alias("b"), F.count_if(F.col("label") == 0).alias("a"))
    units = lambda c: F.when(F.col("place") < 0, F.sum(c)).otherwise(F.count_if(F.col(c) > 0)).alias(c)
    place = value.groupBy("host", "template", "place").agg(units("b"), units("a"), (F.count_if(F.col("b") + F.col("a") == 0) > 0).alias("open"))
    fewest = lambda c: F.coalesce(F.min(F.when(F.col("open"), F.col(c))), F.max(c))
    evidence = place.groupBy("host", "template").agg(fewest("b").alias("b"), fewest("a").alias("a"))
    return evidence.select("host", "template", ((F.col("b") + strength * prior) / (F.col("b") + F.col("a") + strength)).alias("purity"))


def judged(pages: DataFrame, rules=RULES, reject: float = 0.9, strength: float = 4.0, prior: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every row.

    A fitting rule decides; else the template does: it is blocked if its purity (see ``purities``) is ``reject`` or more, so a
    template with little evidence is allowed.
    Null urls and those without a host share the empty host; paths of any length are followed to their end; repeated rows count each; other columns
    are ignored; no rows in, no rows out."""
    host, path = host_and_path()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.when(F.col("_rule.action") == "block", 1).when(F.col("_rule.action") == "allow", 0).alias("label"))
    rows = written(templates(rows), "templates")
    pure = written(purities(rows, strength, prior), "purity")
    verdict = F.when(F.col("label") == 1, "block").when(F.col("label") == 0, "allow").when(F.col("purity") >= reject, "block").otherwise("allow")
    return rows.join(pure, ["host", "template"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
