"""N-gram Jaccard join by a token-group matrix.

Documents are sets of n-word shingles.  Similar sets are partitioned into
groups, each with the union of its tokens; a query's overlap with a group's
union bounds its overlap with any member, and only groups whose bound reaches
the threshold are opened.  Every step before that is a bound as well, so no
link is lost:

1. *Columns* (``ngram_sets``).  Tokens that a single set holds can be in no
   overlap.  A set with more of them than the threshold leaves to spare has no
   partner and goes no further (its documents stay in the result).  This is done
   on a hashed share of all tokens, then on all tokens of the sets left in.
2. *Groups.*  The token space is cut into more parts than two linked sets can
   differ in, so they agree on ``need`` of them at least.  Of the parts that a
   set shares with others the ``need - 1`` that most sets hold are left aside:
   two linked sets still agree on one of the rest.  Sets connected by the rest
   form a cluster, which is cut into groups of GROUP sets or so.
3. *Rows.*  Each group is opened for its own members by one matrix product; the
   best linked sets of a cluster's groups are compared among themselves.
4. *Matrix*, for clusters of several groups.  Only parts held by two components
   or more can bring a new link, and only sets that hold ``need`` of them go on.
   Sets outside the cluster's largest component are laid against the token
   unions of that component's groups, and their arrays are sent to the groups
   whose bound opens.  Among themselves they are dealt into groups by the parts
   they share, the rarest first; a group of more than GROUP sets is dealt again
   by further parts, as long as that takes less than cutting it and comparing
   all of its pieces.

Equal sets are one set throughout.  Links join sets with
``100 * |A and B| >= percent * |A or B|``; components are read off the links.
Tokens are 64-bit hashes, of which 48 bits are compared within a group.  Sets
are told apart by 64-bit hashes up to the links, where two unequal ones pass for
one with odds of n**2 / 2**65 among n sets, and by 128 bits where documents are
told to hold equal sets.

A text with fewer words than n is one token, its whole sequence; a null text or
one without words has an empty set, is linked with nothing and is its own
component.  Repeated rows are equal sets.  An empty table gives an empty
result.  Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bloom import Bloom
from .components import components
from .ngram_sets import Shape, first_pass, pack, signed, still_live, token_sets, unpacked
from .store import table, temporary
from .textops import release, relieve

GROUP = 512  #: sets of a group, about
GROUP_TOKENS = 1_500_000  #: tokens of a group, about
PAIRS = 256  #: pairs of sets that take as long to compare as one copy of a set takes to send, about
BIN_TOKENS = 2_000_000  #: tokens of the small groups that one call opens, about
VISITS, VISIT_TOKENS = 16_384, 8_000_000  #: visitors that meet a group at once, and their tokens, about
UNIONS = 64  #: groups whose unions are looked at together
DENSE = 8  #: tokens in more sets of a group than this go through a matrix product
_BAND = 63  #: bits of a signature that say its band


def agreements(sets: DataFrame) -> DataFrame:
    """(sig, node, pivot) of the parts that make candidates, pivot the smallest node of each.

    A set that shares fewer signatures of a band than a link there takes has no
    link there, and its signatures of that band go; of the others those that
    most sets hold are left aside, one fewer than a link takes.  What then is
    left to one set alone goes too.
    """

    def shared(rows: DataFrame) -> DataFrame:
        both = rows.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("top"), F.count("*").alias("held")).where("pivot <> top")
        return rows.join(table(both.drop("top"), "parts"), "sig")

    each = sets.select("node", F.explode(F.arrays_zip(F.col("signatures").alias("sig"), F.col("needs").alias("need"))).alias("s")).select("node", "s.sig", "s.need")
    found = shared(each).withColumn("band", F.col("sig").bitwiseAND(F.lit(_BAND).cast("long"))).dropDuplicates(["node", "band", "sig"])  # a set may come from several mappers
    mine = Window.partitionBy("node", "band")
    found = found.withColumn("n", F.count("*").over(mine)).withColumn("rank", F.row_number().over(mine.orderBy("held", "sig")))
    found = table(found.where("n >= need and rank <= n - need + 1").select("sig", "node"), "agreements")
    return table(shared(found).select("sig", "node", "pivot"), "agreements")


def clusters(agree: DataFrame) -> DataFrame:
    """(node, cluster) of sets connected by agreements (node, pivot).

    Each set goes to the smallest of its pivots; what is left to connect are
    pairs of pivots that a set has in common, far fewer than the agreements
    where many sets are alike.
    """
    own = table(agree.groupBy("node").agg(F.min("pivot").alias("low"), F.collect_set("pivot").alias("pivots")), "pivots")
    pairs = own.select("low", F.explode("pivots").alias("pivot")).where("low <> pivot").distinct()
    found = components(pairs, "low", "pivot").select(F.col("node").alias("low"), "comp")
    return own.select("node", "low").join(found, "low", "left").select("node", F.coalesce("comp", "low").alias("cluster"))


# -- opening groups ---------------------------------------------------------
def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """|A and B| for all sets of a and b."""
    rows = np.concatenate([np.repeat(np.arange(len(a)), [len(x) for x in a]), len(a) + np.repeat(np.arange(len(b)), [len(x) for x in b])])
    token = np.concatenate([*a, *b])
    order = np.argsort(token, kind="stable")
    rows, token = rows[order], token[order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(token)])
    out = np.zeros(len(a) * len(b), np.int64)
    # tokens of few sets: all pairs of their places
    few = np.repeat((count > 1) & (count <= DENSE), count)
    r, t = rows[few], token[few]
    for step in range(1, DENSE):
        left, right = r[:-step], r[step:]
        hit = (t[:-step] == t[step:]) & (left < len(a)) & (right >= len(a))
        out += np.bincount(left[hit] * len(b) + right[hit] - len(a), minlength=len(out))
    out = out.reshape(len(a), len(b)).astype(np.float32)
    # tokens of many sets: columns of a matrix
    many = np.repeat(count > DENSE, count)
    r, col = rows[many], np.repeat(np.arange((count > DENSE).sum()), count[count > DENSE])
    wide = 4096
    cuts = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + wide, wide))
    for k in range(len(cuts) - 1):
        m = np.zeros((len(a) + len(b), wide), np.float32)
        s = slice(cuts[k], cuts[k + 1])
        m[r[s], col[s] - k * wide] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


def _groups(rows: pd.DataFrame, *keys: str):
    """The rows of each group that a bin holds, by node."""
    rows = rows.sort_values([*keys, "node"], kind="stable")
    held = [rows[k].to_numpy() for k in keys]
    edge = np.zeros(max(0, len(rows) - 1), bool)
    for x in held:
        edge |= x[1:] != x[:-1]
    cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), len(rows)]
    for at, to in zip(cuts, cuts[1:], strict=False):
        if to > at:
            yield rows.iloc[at:to]


def _within(shape: Shape, rows: pd.DataFrame, *keys: str) -> pd.DataFrame:
    """Local components of each group of a bin: node, comp (smallest node), and its number of links."""
    out = []
    for group in _groups(rows, *keys):
        node, size, sets = group["node"].to_numpy(), group["size"].to_numpy(), unpacked(group["tokens"])
        if len(node) == 1:
            out.append((node, node, np.ones(1, np.int64)))
            continue
        link = shape.linked(overlaps(sets, sets), size[:, None], size[None, :])
        label = np.arange(len(node))
        while True:
            new = np.minimum(label, np.where(link, label[None, :], len(node)).min(1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        out.append((node, node[label], link.sum(1)))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    release()
    return pd.DataFrame({"node": cols[0], "comp": cols[1], "links": cols[2]})


def _crossing(shape: Shape, rows: pd.DataFrame, *keys: str) -> pd.DataFrame:
    """Links between sets of different components in each group of a bin: one for each two components of a group."""
    found = []
    for group in _groups(rows, *keys):
        comp = group["comp"].to_numpy()
        if (comp == comp[0]).all():
            continue
        node, size, sets = group["node"].to_numpy(), group["size"].to_numpy(), unpacked(group["tokens"])
        link = shape.linked(overlaps(sets, sets), size[:, None], size[None, :]) & (comp[:, None] < comp[None, :])
        a, b = np.nonzero(link)
        _, one = np.unique(np.stack([comp[a], comp[b]], 1), axis=0, return_index=True)
        found += zip(node[a[one]].tolist(), node[b[one]].tolist(), strict=True)
    relieve()
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _visit(shape: Shape, visitors: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """A link of each visitor to each component it reaches in a group."""
    found = []
    if len(visitors) and len(members):
        sets, size, comp, node = unpacked(members["tokens"]), members["size"].to_numpy(), members["comp"].to_numpy(), members["node"].to_numpy()
        for at in range(0, len(visitors), GROUP):
            some = visitors.iloc[at : at + GROUP]
            link = shape.linked(overlaps(unpacked(some["tokens"]), sets), some["size"].to_numpy()[:, None], size[None, :])
            for i, q in enumerate(some["node"]):
                hit = np.flatnonzero(link[i])
                _, one = np.unique(comp[hit], return_index=True)
                found += [(q, node[j]) for j in hit[one]]
    relieve()
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _opened(shape: Shape, guests: pd.DataFrame, unions: pd.DataFrame) -> pd.DataFrame:
    """(node, grp) of the groups that each guest's bound opens."""
    found = []
    if len(guests) and len(unions):
        sets, size, node = unpacked(guests["tokens"]), guests["size"].to_numpy(), guests["node"].to_numpy()
        own, token = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        for grp, least, union in zip(unions["grp"], unions["least"], unpacked(unions["tokens"]), strict=True):
            bound = np.bincount(own[np.isin(token, union)], minlength=len(sets))
            hit = np.flatnonzero((100 * bound >= shape.percent * size) & (100 * size >= shape.percent * least))
            found += [(q, grp) for q in node[hit].tolist()]
    relieve()
    return pd.DataFrame(found, columns=["node", "grp"]).astype("int64")


# -- step 4 -------------------------------------------------------------------
def _bins(rows: DataFrame, *keys: str) -> DataFrame:
    """``bin``: small groups of about BIN_TOKENS tokens in all that are opened in one call."""
    n = int((rows.agg(F.sum("size")).first()[0] or 0) // BIN_TOKENS) + 1
    return rows.withColumn("bin", F.pmod(F.xxhash64(*keys), F.lit(n)))


def contacts(rows: DataFrame) -> DataFrame:
    """The sets of split clusters that may have a link to another component, with the parts that may bring it.

    rows: node, cluster, grp, comp, inside (of the cluster's largest component),
    size, tokens, signatures, needs.  ``among``: signatures shared with another
    component outside, as many of a band as a link takes or none, with ``needs``;
    ``across``: it shares as many with sets on the other side.
    """

    def held(rows: pd.DataFrame) -> pd.DataFrame:
        """The distinct signatures of each component within a group."""
        comps, code = np.unique(rows["comp"].to_numpy(), return_inverse=True)
        inside = np.zeros(len(comps), bool)
        inside[code] = rows["inside"].to_numpy(bool)
        lists = [np.asarray(x, np.int64) for x in rows["signatures"]]
        code, sig = np.repeat(code, [len(x) for x in lists]), np.concatenate(lists)
        order = np.lexsort((sig, code))
        code, sig = code[order], sig[order]
        fresh = np.r_[True, (code[1:] != code[:-1]) | (sig[1:] != sig[:-1])][: len(sig)]
        code, sig = code[fresh], sig[fresh]
        relieve()
        return pd.DataFrame({"cluster": rows["cluster"].iat[0], "grp": rows["grp"].iat[0], "comp": comps[code], "inside": inside[code], "sig": sig})

    each = table(rows.groupBy("cluster", "grp").applyInPandas(held, "cluster long, grp long, comp long, inside boolean, sig long"), "held")
    out_comp = F.when(~F.col("inside"), F.col("comp"))
    by = each.groupBy("sig").agg((F.min(out_comp) != F.max(out_comp)).alias("among"), (F.max("inside") & ~F.min("inside")).alias("across"))
    by = by.where("among or across").select("sig", F.coalesce("among", F.lit(False)).alias("among"), F.coalesce("across", F.lit(False)).alias("across"))
    mine = table(each.select("cluster", "grp", "sig").distinct().join(by, "sig"), "met-parts")

    def enough(sig: np.ndarray, need: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        take = np.isin(sig, known)
        sig, need = sig[take], need[take]
        count = np.bincount(sig & _BAND, minlength=_BAND + 1)
        take = count[sig & _BAND] >= need
        return sig[take], need[take]

    names = ["node", "cluster", "grp", "comp", "inside", "size", "tokens", "signatures", "needs"]

    def cut(rows: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        sig = met["sig"].to_numpy(np.int64)
        among, across = sig[met["among"].to_numpy(bool)], sig[met["across"].to_numpy(bool)]
        found = []
        for i, (s, n, inside) in enumerate(zip(rows["signatures"], rows["needs"], rows["inside"], strict=True)):
            s, n = np.asarray(s, np.int64), np.asarray(n, np.int64)
            (a, need), (b, _) = enough(s, n, among[:0] if inside else among), enough(s, n, across)
            if len(a) or len(b):
                found.append((i, a, need, len(b) > 0))
        relieve()
        rows = rows.iloc[[x[0] for x in found]].reset_index(drop=True)[names[:-2]]
        return rows.assign(among=[x[1] for x in found], needs=[x[2] for x in found], across=[x[3] for x in found])

    keys = ["cluster", "grp"]
    kind = "node long, cluster long, grp long, comp long, inside boolean, size long, tokens binary, among array<long>, needs array<int>, across boolean"
    found = rows.select(*names).groupBy(*keys).cogroup(mine.groupBy(*keys)).applyInPandas(cut, kind)
    return table(found, "contacts")


def cost(n: Column) -> Column:
    """What a group of n takes: its pairs, and the copies of its sets if it is cut into pieces of GROUP and all pieces meet."""
    return n * n + PAIRS * n * F.ceil(n / GROUP)


def dealt(rows: DataFrame) -> DataFrame:
    """(key, node): groups in which any two linked sets of different components meet; rows: node, cluster, comp, among, needs.

    A group is a list of sets that share some parts, ``rest`` the parts that
    linked ones may share besides, ``need`` how many of these they do.  It is
    dealt by the rarest of them: of a set's c parts the first c - need + 1, one
    of which the two have in common, as the first that they share.
    """
    band = lambda s: s.bitwiseAND(F.lit(_BAND).cast("long"))
    each = rows.select("node", "cluster", "comp", F.explode(F.arrays_zip(F.col("among").alias("sig"), F.col("needs").alias("need"))).alias("s"))
    each = each.select("node", "comp", F.xxhash64("cluster", band(F.col("s.sig"))).alias("key"), "s.sig", "s.need")
    level = each.groupBy("key", "node", "comp").agg(F.max("need").alias("need"), F.collect_set("sig").alias("rest"))
    out: list[DataFrame] = []
    while True:
        level = table(level, "dealt-level")
        sizes = table(level.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("need").alias("need")).where("low <> high").drop("low", "high"), "dealt-sizes")
        out.append(level.join(sizes.where(F.col("n") <= GROUP).select("key"), "key").select("key", "node"))
        # what dealing the larger ones again would make of them
        parts = level.join(sizes.where((F.col("n") > GROUP) & (F.col("need") >= 1)).select("key"), "key").select("key", "node", "comp", "need", F.explode("rest").alias("sig"))
        held = table(parts.groupBy("key", "sig").agg(F.count("*").alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").drop("low", "high"), "dealt-held")
        ranked = parts.join(held, ["key", "sig"]).groupBy("key", "node", "comp", "need").agg(F.array_sort(F.collect_list(F.struct("held", "sig"))).alias("order"))
        ranked = table(ranked.where(F.size("order") >= F.col("need")).select("key", "node", "comp", "need", F.col("order.sig").alias("order")), "dealt-ranked")
        first = ranked.select("key", "node", "comp", F.posexplode(F.slice("order", F.lit(1), F.size("order") - F.col("need") + 1)).alias("at", "sig"))
        first = table(first.select("key", "node", "at", F.xxhash64("key", "sig").alias("next")), "dealt-next")
        again = first.groupBy("key", "next").agg(F.count("*").alias("n")).where("n > 1").groupBy("key").agg(F.sum(cost(F.col("n"))).alias("again"))
        plan = sizes.where(F.col("n") > GROUP).join(again, "key", "left").select("key", "n", "need", F.when((F.col("need") >= 1) & (F.coalesce("again", F.lit(0)) < cost(F.col("n"))), True).otherwise(False).alias("deal"))
        plan = table(plan, "dealt-plan")
        out.append(_pieces(level.select("key", "node").join(plan.where("not deal").select("key", "n"), "key")))
        more = plan.where("deal").select("key")
        if more.isEmpty():
            break
        few = first.join(more, "key").select("key", "node", "at", "next")
        level = few.join(ranked.select("key", "node", "comp", "need", "order"), ["key", "node"])
        level = level.select(F.col("next").alias("key"), "node", "comp", (F.col("need") - 1).alias("need"), F.slice("order", F.col("at") + 2, F.size("order")).alias("rest"))
    return table(out[0] if len(out) == 1 else _all(out), "dealt")


def _pieces(rows: DataFrame) -> DataFrame:
    """(key, node): groups cut into pieces of GROUP, a group for each two of them; rows: key, node, n."""
    cut = F.ceil(F.col("n") / GROUP)
    mine = F.pmod(F.xxhash64("node", F.lit(5)), cut)
    both = rows.select("key", "node", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)).alias("other"))
    return both.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "node")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def across(zone: DataFrame, shape: Shape) -> DataFrame:
    """Links (a, b) of outside sets to the largest component of their cluster: group unions first, then the groups that open."""
    hosts = zone.where("inside and across")
    guests = zone.where("not inside and across")
    if hosts.isEmpty():
        return zone.sparkSession.createDataFrame([], "a long, b long")

    def union(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = np.unique(np.concatenate(unpacked(rows["tokens"])))
        relieve()
        return pd.DataFrame([(rows["cluster"].iat[0], rows["grp"].iat[0], rows["size"].min(), pack(tokens))], columns=["cluster", "grp", "least", "tokens"])

    unions = table(hosts.groupBy("cluster", "grp").applyInPandas(union, "cluster long, grp long, least long, tokens binary"), "unions")
    at = F.floor(F.col("grp") / UNIONS).alias("at")
    ats = unions.select("cluster", at).distinct()
    turns = guests.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / VISITS), F.ceil(F.sum("size") / VISIT_TOKENS)).alias("turns"))
    turn = F.pmod(F.xxhash64("node", F.lit(3)), F.col("turns")).alias("turn")
    asking = guests.join(turns, "cluster").select("cluster", turn, "node", "size", "tokens").join(ats, "cluster")
    asked = unions.withColumn("at", at).join(turns, "cluster").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    keys = ["cluster", "at", "turn"]
    opened = asking.groupBy(*keys).cogroup(asked.select(*keys, "grp", "least", "tokens").groupBy(*keys)).applyInPandas(lambda g, u: _opened(shape, g, u).assign(cluster=g["cluster"].iat[0] if len(g) else 0), "node long, grp long, cluster long")
    opened = table(opened, "opened")

    keys = ["cluster", "grp", "turn"]
    visits = opened.join(guests.select("node", "size"), "node")
    turns = table(visits.groupBy("cluster", "grp").agg(F.greatest(F.ceil(F.count("*") / VISITS), F.ceil(F.sum("size") / VISIT_TOKENS)).alias("turns")), "turns")
    visitors = opened.join(turns, ["cluster", "grp"]).select("cluster", "grp", "node", turn).join(guests.select("node", "size", "tokens"), "node")
    visitors = visitors.select(*(F.col(c).alias(c) for c in (*keys, "node", "size", "tokens")))  # columns apart from the hosts', which come from the same table
    hosting = hosts.join(turns, ["cluster", "grp"]).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    return visitors.groupBy(*keys).cogroup(hosting.select(*keys, "node", "size", "comp", "tokens").groupBy(*keys)).applyInPandas(lambda v, m: _visit(shape, v, m), "a long, b long")


def crossed(split: DataFrame, found: DataFrame, shape: Shape) -> DataFrame:
    """Step 4: links between components of clusters that are cut into several groups.

    split: node, cluster, grp, size, tokens, signatures, needs; found: the links so far.
    """
    comp = split.select("node", "cluster").join(components(found).withColumnRenamed("comp", "c"), "node", "left").select("node", "cluster", F.coalesce("c", "node").alias("comp"))
    comp = table(comp, "split-comps")
    # an inside is worth its groups only if it fills some
    sizes = comp.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("n", "comp")).alias("x")).where(F.col("x.n") >= GROUP).select("cluster", F.col("x.comp").alias("largest"))
    comp = comp.join(largest, "cluster", "left").select("node", "comp", F.coalesce(F.col("comp") == F.col("largest"), F.lit(False)).alias("inside"))
    zone = contacts(table(split.join(comp, "node"), "split-sets"))
    outside = zone.where("not inside and size(among) > 0")
    groups = dealt(outside)
    met = table(groups.join(outside.select("node", "comp", "size", "tokens"), "node"), "dealt-sets")
    among = _bins(met, "key").groupBy("bin").applyInPandas(lambda rows: _crossing(shape, rows, "key"), "a long, b long")
    return among.unionByName(across(zone, shape))


def links(docs: DataFrame, shape: Shape, live: DataFrame, text_col: str = "text") -> DataFrame:
    """Edges (a, b) between sets whose components are those of all links; live: (node) of the sets that step 1 leaves in."""
    left = table(token_sets(docs, shape, Bloom(live), text_col), "token-sets")
    sets = table(signed(left, shape, Bloom(still_live(left, shape))), "signed-sets")

    # step 2: clusters of sets that agree on a part
    cluster = clusters(agreements(sets))
    sizes = sets.select("node", "size").distinct().join(cluster, "node")
    shares = sizes.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("size") / GROUP_TOKENS)).alias("groups"))
    place = table(sizes.join(shares, "cluster").select("node", "cluster", "groups", F.pmod(F.xxhash64("node"), F.col("groups")).alias("grp")), "places")

    # step 3: each group opened for its members; token arrays are dealt by node once, a set that came from several mappers is one
    placed = sets.hint("merge").join(place, "node").groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "tokens", "cluster", "groups", "grp")), *(F.first(F.when(F.col("groups") > 1, F.col(c))).alias(c) for c in ("signatures", "needs")))
    placed = table(placed, "placed")
    kind = "node long, comp long, links long"
    local = _bins(placed, "cluster", "grp").select("bin", "cluster", "grp", "node", "size", "tokens")
    local = table(local.groupBy("bin").applyInPandas(lambda rows: _within(shape, rows, "cluster", "grp"), kind), "local")
    edges = lambda rows: rows.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    found = edges(local)
    split = placed.where("groups > 1").drop("groups")
    if place.where("groups > 1").isEmpty():
        return found

    # the best linked sets of a cluster's groups, among themselves: they join the parts of a large component
    best = F.row_number().over(Window.partitionBy("cluster", "grp").orderBy(F.desc("links"), "node"))
    hubs = place.where("groups > 1").join(local, "node").withColumn("n", best).where("n = 1").select("node", "cluster", F.floor(F.col("grp") / GROUP).alias("grp"))
    met = split.select("node", "size", "tokens").join(hubs, "node").groupBy("cluster", "grp").applyInPandas(lambda rows: _within(shape, rows, "cluster", "grp"), kind)
    found = table(found.unionByName(edges(met)), "links")
    return found.unionByName(crossed(split, found, shape))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_shingles`` and ``component_id`` (smallest id reachable by links) of every document."""
    shape = Shape(n, percent)
    with temporary(docs.sparkSession):
        nodes, live = first_pass(docs, shape, id_col, text_col)
        nodes = table(nodes, "nodes", keep=True)
        label = components(links(docs, shape, live, text_col))
        # sets by both hashes; those without a link are components of their own
        classes = nodes.where("n_shingles > 0").groupBy("node", "node2").agg(F.min(id_col).alias("least"))
        key = F.struct(F.coalesce("comp", "node").alias("one"), F.when(F.col("comp").isNull(), F.col("node2")).alias("two"))
        classes = table(classes.join(label, "node", "left").select("node", "node2", "least", key.alias("key")), "classes")
        least = classes.groupBy(F.col("key.one").alias("one"), F.coalesce("key.two", F.lit(0)).alias("two")).agg(F.min("least").alias("component_id"))
        classes = classes.join(least, (F.col("key.one") == F.col("one")) & (F.coalesce("key.two", F.lit(0)) == F.col("two"))).select("node", "node2", "component_id")
        classes = table(classes, "classes", keep=True)
    rows = nodes.join(classes, ["node", "node2"], "left")
    return rows.select(id_col, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))

def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, one of each component: that of the smallest id, once if its rows repeat.

    Rows without an id cannot be named as a copy and all stay.
    """
    kept = near_duplicates(docs, n, percent, id_col, text_col).where(F.col(id_col) == F.col("component_id"))
    kept = table(kept.groupBy(F.col(id_col).alias("__kept")).agg(F.count("*").alias("__rows")), "kept")
    # the texts are dealt by id at every size, not only where the ids are too many to send
    out = docs.hint("merge").join(kept, F.col(id_col) == F.col("__kept"), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    again = kept.where("__rows > 1").select("__kept")
    if again.isEmpty():
        return out
    once = docs.join(kept.where("__rows = 1"), F.col(id_col) == F.col("__kept"), "left_semi")
    twice = docs.join(again, F.col(id_col) == F.col("__kept"), "left_semi").dropDuplicates([id_col])
    return once.unionByName(twice).unionByName(docs.where(F.col(id_col).isNull()))
