"""URL filters: fixed host and path rules first, else a path-template tree with labelled purity.

Per host the path segments form a tree.  Below each branch a segment's value is variable, and becomes a
wildcard, where the branch has at least LEAST_VALUES values, more than the value has pages: user names and
identifiers are, the few sections of a site aren't, whatever they look like.  The tree grows one branching
level at a time, for a wildcard's pages share the branches below it; segments that all paths of a branch share are
passed in one step, and paths of branches with fewer paths than LEAST_VALUES are done.

The labels are split in two by page.  One half merges: sibling branches whose shares of bad pages, drawn towards their
parent's, fall in the same band become one.  The other half judges: merged branches stay apart from their parent only if
its labels differ from the parent's by more than chance would give any of the parent's merged branches, so labels
that picked a branch are never those that condemn it.  A page is judged by the deepest branch that stays apart, or by
all labelled pages if none does, and rejected if the smoothed share of bad pages is at least one half.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, settle

#: Fixed values: (rule, verdict). A rule is a host, with its subdomains, and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Weight of the parent's share in a branch's smoothed share, in pages; how likely chance alone may set any branch of a parent apart;
#: bands of shares that merge, of equal width in the arcsine of their root.
SMOOTHING, CHANCE, BANDS = 4.0, 0.01, 6
#: Values that a branch's segment has at least where some are variable.
LEAST_VALUES = 8


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; without :// empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str) -> Column:
    host, path = rule.split("/", 1)
    return ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")


def _ruled(pick: int) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(RULES, key=lambda r: len(r[0])):  # the longest is asked first
        out = F.when(_fits(rule[0]), F.lit(rule[pick])).otherwise(out)
    return out


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with (host, segments, wild) last: these give way to the template and the keys of its branches, each a hash of the one above and a part."""
    for batch in batches:
        hosts, segments, wild = (batch[c].to_pylist() for c in ("host", "segments", "wild"))
        templates, nodes = [], []
        for host, own, at in zip(hosts, segments, wild, strict=True):
            for k in at:
                own[k] = "*"
            templates.append("/".join([host, *own]) if own else f"{host}/")
            key = hashlib.blake2b(host.encode(), digest_size=8).digest()
            keys = [key]
            for part in own:
                key = hashlib.blake2b(key + part.encode(), digest_size=8).digest()
                keys.append(key)
            nodes.append([int.from_bytes(k, "little", signed=True) for k in keys])
        kept = [c for c in batch.schema.names if c not in ("segments", "wild")]
        out = pa.Table.from_batches([batch]).select(kept).append_column("template", pa.array(templates, pa.string())).append_column("nodes", pa.array(nodes, pa.list_(pa.int64())))
        yield from out.combine_chunks().to_batches()


def path_templates(paths: DataFrame) -> DataFrame:
    """paths (host, path, pages, and any others) with template and nodes: the 64-bit keys of the branches from the host down to the template.

    Rows are distinct paths.  Rounds are as many as some path has branchings below which LEAST_VALUES paths lie.
    """
    named = paths.columns
    columns = [*named, "segments", "level", "branch", "wild"]
    start = paths.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("level", F.lit(0))
    now = settle(start.withColumn("branch", F.xxhash64("host")).withColumn("wild", F.array().cast("array<int>")), "paths")
    done = None
    while True:
        rest = F.slice("segments", F.col("level") + 1, F.size("segments"))
        open_ = now.where(F.size("segments") > F.col("level"))
        size = open_.groupBy("branch").agg(F.count("*").alias("n_paths"), F.min(rest).alias("low"), F.max(rest).alias("high")).where(F.col("n_paths") >= LEAST_VALUES)
        unlike = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
        shared = F.when(unlike > 0, unlike - 1).otherwise(F.size("low"))
        size = settle(size.select("branch", shared.alias("shared")), "sizes")
        ended = now.join(size, "branch", "left_anti").unionByName(now.where(F.size("segments") <= F.col("level")).join(size, "branch", "left_semi")).select(*columns)
        done = ended if done is None else done.unionByName(ended)
        if not size.head(1):
            break
        stay = open_.join(size, "branch").withColumn("level", F.col("level") + F.col("shared")).withColumn("value", F.get("segments", F.col("level")))
        values = stay.where("value is not null").groupBy("branch", "value").agg(F.sum("pages").alias("value_pages"))
        many = values.groupBy("branch").agg(F.count("*").alias("n_values")).where(F.col("n_values") >= LEAST_VALUES)
        wild = values.join(many, "branch").where("value_pages < n_values").select(F.col("branch").alias("wild_branch"), F.col("value").alias("wild_value"))
        # a null value is the end of a path, which no wildcard meets
        stepped = stay.join(wild, (F.col("branch") == F.col("wild_branch")) & (F.col("value") == F.col("wild_value")), "left")
        variable = F.col("wild_value").isNotNull()
        stepped = stepped.withColumn("wild", F.when(variable, F.concat("wild", F.array("level"))).otherwise(F.col("wild")))
        part = F.when(variable, F.lit("*")).otherwise(F.col("value"))
        # a literal * is not the wildcard; both have its template, so their keys are one in the end
        stepped = stepped.withColumn("branch", F.when(F.col("value").isNull(), F.col("branch")).otherwise(F.xxhash64("branch", part)))
        now = settle(stepped.withColumn("level", F.when(F.col("value").isNull(), F.col("level")).otherwise(F.col("level") + 1)).select(*columns), "paths")
    slim = done.select(*named, "segments", "wild")
    shape = ", ".join([*(f"`{c}` {t}" for c, t in slim.dtypes[:-2]), "template string", "nodes array<long>"])
    return slim.mapInArrow(_named, shape)


def _share(bad: str, rows: str) -> Column:
    return F.try_divide(F.col(bad).cast("double"), F.col(rows))


def merge_siblings(counted: DataFrame) -> DataFrame:
    """counted (parent, node, bad, rows, merge_bad, merge_rows, above: the parent's share in the merging half, ...) with the figures group_bad and
    group_rows of all siblings in the same band."""
    drawn = (F.col("merge_bad") + SMOOTHING * F.col("above")) / (F.col("merge_rows") + SMOOTHING)
    band = F.least(F.lit(BANDS - 1), F.floor(F.asin(F.sqrt(drawn)) * (2 * BANDS / math.pi))).cast("int")
    banded = counted.withColumn("band", band)
    groups = banded.groupBy(F.col("parent").alias("of_parent"), F.col("band").alias("of_band")).agg(F.sum("bad").alias("group_bad"), F.sum("rows").alias("group_rows"))
    return banded.join(groups, (F.col("parent") == F.col("of_parent")) & (F.col("band") == F.col("of_band"))).drop("of_parent", "of_band")


def _surprise(share: Column, p: Column) -> Column:
    """The relative entropy of a share to p, in nats a page; chance gives k or more of n with a probability below exp(-n times this)."""
    term = lambda a, b: F.when(a > 0, F.when(b > 0, a * F.log(a / b)).otherwise(F.lit(float("inf")))).otherwise(F.lit(0.0))
    return term(share, p) + term(1 - share, 1 - p)


def decisive_branches(paths: DataFrame) -> tuple[DataFrame, tuple[int, int] | None]:
    """(node, depth, share) of the branches that stay apart, hosts against all pages, others against their parent; and (bad, rows) of all pages.

    paths: (nodes, bad, rows, merge_bad, merge_rows): labelled pages of a path in the judging and in the merging half; None stands for no labels.
    """
    figures = ["bad", "rows", "merge_bad", "merge_rows"]
    deep = paths.where("rows + merge_rows > 0").select(*figures, F.posexplode("nodes").alias("depth", "node"), "nodes")
    parent = F.when(F.col("depth") > 0, F.get("nodes", F.col("depth") - 1))
    counted = settle(deep.withColumn("parent", parent).drop("nodes").groupBy("node", "depth", "parent").agg(*[F.sum(c).alias(c) for c in figures]), "branches")
    whole = counted.where("depth = 0").agg(*[F.sum(c).alias(c) for c in figures], F.count("*").alias("hosts")).first()  # one row
    if whole["rows"] is None:
        return counted.select("node", "depth", F.lit(0.0).alias("share")), None
    total = (whole["bad"] + whole["merge_bad"], whole["rows"] + whole["merge_rows"])
    overall = total[0] / total[1]
    # hosts have no parent to be gathered under: each stands for itself
    hosts = counted.where("depth = 0").select("node", "depth", F.col("bad").alias("group_bad"), F.col("rows").alias("group_rows"), F.lit(overall).alias("p"), F.lit(whole["hosts"]).alias("rivals"))
    up = counted.select(F.col("node").alias("up_node"), F.col("depth").alias("up_depth"), _share("bad", "rows").alias("p"), _share("merge_bad", "merge_rows").alias("above"))
    both = counted.where("depth > 0").join(up, (F.col("parent") == F.col("up_node")) & (F.col("depth") == F.col("up_depth") + 1))
    both = both.withColumn("p", F.coalesce("p", F.lit(overall))).withColumn("above", F.coalesce("above", F.lit(overall)))
    merged = merge_siblings(both).select("node", "depth", "group_bad", "group_rows", "p", F.lit(BANDS).cast("long").alias("rivals")).unionByName(hosts).where("group_rows > 0")
    far = F.col("group_rows") * _surprise(_share("group_bad", "group_rows"), F.col("p"))
    share = (F.col("group_bad") + SMOOTHING * F.col("p")) / (F.col("group_rows") + SMOOTHING)
    return merged.where(far >= F.log(F.col("rivals") / CHANCE)).select("node", "depth", share.alias("share")), total


def judge_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, bad_share) of every row of pages (page_id, url).

    labels (doc_id, quality): pages are labelled by the row of their id, bad where quality is 0 in any of that
    id's rows; pages that a rule fits are not learnt from.  rule is the longest that fits, else null;
    a rule's path must start the url's, so an empty path fits none.  verdict is the rule's, else block
    where the template's smoothed bad share is at least one half; that of all labelled pages stands in
    where no branch of the template stays apart.  A null url, or one without ://,
    has an empty host and path, and is judged as the tree's empty host.  Repeated rows count as often as they occur
    and are judged alike; a null page_id has no label; urls may be of any length and depth; branches are told by 64-bit
    keys; a page's labels go to the merging or the judging half by its id; other columns are ignored.  Without labels all pages that no rule fits are allowed.  No rows give no rows.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("known_bad"))
    labelled = named.join(known, F.col("page_id") == F.col("doc_id"), "left")
    merging = F.xxhash64("page_id") % 2 == 0
    half = lambda own: [F.coalesce(F.sum(F.when(own, F.col("known_bad"))), F.lit(0)), F.count(F.when(own, F.col("known_bad")))]
    named_as = ["bad", "rows", "merge_bad", "merge_rows"]
    paths = labelled.groupBy("host", "path").agg(F.count("*").alias("pages"), *[c.cast("long").alias(n) for c, n in zip([*half(~merging), *half(merging)], named_as, strict=True)])
    paths = settle(path_templates(paths.withColumn("rule", _ruled(0)).withColumn("ruled", _ruled(1))), "templates")
    branches, whole = decisive_branches(paths.where("rule is null").select("nodes", *named_as))
    branches = settle(branches, "decisive")
    key, overall = F.element_at("nodes", -1), F.lit(whole[0] / whole[1] if whole else None).cast("double")
    # the distinct templates, not the pages, meet the branches
    met = paths.where("rule is null").select("nodes").distinct().select(key.alias("met_key"), F.posexplode("nodes").alias("at", "met_node"))
    met = met.join(branches, (F.col("met_node") == F.col("node")) & (F.col("at") == F.col("depth"))).groupBy("met_key").agg(F.max(F.struct("depth", "share")).alias("m"))
    judged = paths.select("host", "path", "rule", "ruled", "template", key.alias("key")).join(met.select("met_key", F.col("m.share").alias("met_share")), F.col("key") == F.col("met_key"), "left")
    judged = judged.withColumn("bad_share", F.when(F.col("rule").isNull(), F.coalesce("met_share", overall)))
    verdict = F.coalesce("ruled", F.when(F.coalesce(F.col("bad_share"), F.lit(0.0)) >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    judged = settle(judged.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "rule", verdict.alias("verdict"), "template", "bad_share"), "judged")
    for used in (branches, paths):
        discard(used)
    # a url that very many pages share makes a hot key, whose pages Spark splits
    out = named.join(judged, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")))
    return out.select("page_id", "host", "path", "rule", "verdict", "template", "bad_share")
