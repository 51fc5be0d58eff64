"""Resolving pins of one place to a representative: names, distances, footprints, manual overrides.

pins: pin, category, name, lat, lon, reviews. Edges: category, child, parent, source. All pair work is blocked on
(category, cell, shared word), so its size follows the real neighbours and not the square of a category. Joins on pins are shuffled,
never broadcast, as the driver would hold one side whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions import geo
from placewright.functions import names as N
from placewright.plans.graph import components, roots
from placewright.plans.tables import written

NAME_M, SUB_M, SAME_M, COMPLEX_M, SATELLITE_M = 300.0, 400.0, 60.0, 700.0, 500.0
SUBSET_REVIEWS, SATELLITE_REVIEWS = 50, 60
CONTAINER_M2 = (3.0e5, 2.0e7)
FOLD_M = {"sparse": 2500.0, "mid": 900.0, "urban": 500.0}
FOLD_M2 = {"sparse": 1.0e6, "mid": 0.2e6}
CAMPUS = ("hospital",)


def described(pins: DataFrame, campus: tuple[str, ...] = CAMPUS) -> DataFrame:
    """Adds what the rules read from a name: sub, toks, dist, full, dsub, words (those a pair must share), reviews."""
    n = F.col("name")
    is_campus = F.col("category").isin(*campus) if campus else F.lit(False)
    df = pins.withColumns(
        {
            "reviews": F.coalesce("reviews", F.lit(0)), "sub": N.is_sub(n), "toks": N.sig_tokens(n), "dist": N.distinctive(n),
            "full": N.distinctive_full(n), "dsub": N.distinctive(n, True), "campus": is_campus,
        }
    )
    return df.withColumn("words", F.when(F.col("campus"), F.col("full")).otherwise(F.col("dist")))


def _sides(df: DataFrame, p: str) -> DataFrame:
    return df.select([F.col(c).alias(p + c) for c in df.columns])


def near_sharing(left: DataFrame, right: DataFrame, left_words: str, right_words: str, meters: float) -> DataFrame:
    """Pairs of one category at most `meters` apart that share a word: l_*, r_*, d; each pair once."""
    a, b = _sides(left, "l_"), _sides(right, "r_")
    ka = geo.with_near_cells(a.select("l_pin", "l_lat", "l_lon", F.col("l_category").alias("_k"), f"l_{left_words}"), "l_lat", "l_lon", meters, "_c")
    kb = geo.with_cell(b.select("r_pin", "r_lat", "r_lon", F.col("r_category").alias("_k"), f"r_{right_words}"), "r_lat", "r_lon", meters, "_c")
    ka, kb = ka.select("l_pin", "_k", F.explode(f"l_{left_words}").alias("_w"), "_c"), kb.select("r_pin", "_k", F.explode(f"r_{right_words}").alias("_w"), "_c")
    ids = ka.join(kb.hint("merge"), ["_k", "_w", "_c"]).where("l_pin <> r_pin").select("l_pin", "r_pin").distinct()
    out = ids.join(a.hint("merge"), "l_pin").join(b.hint("merge"), "r_pin").withColumn("d", geo.haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")))
    return out.where(F.col("d") <= meters)


def near_pairs(left: DataFrame, right: DataFrame, meters: float) -> DataFrame:
    """Pairs of one category at most `meters` apart, whatever their names."""
    from .joins import within

    return within(left, right, meters, by=["category"]).where("l_pin <> r_pin")


def merge_pairs(pins: DataFrame) -> DataFrame:
    """E4. Pairs of whole places (no sub-parts) that are one place: they share a telling word and are at one spot, or
    have the same words, or (campus) share two words within 700 m, or one name's words are among the other's and that
    one has few reviews. l_pin < r_pin."""
    real = pins.where(~F.col("sub"))
    p = near_sharing(real, real, "words", "words", COMPLEX_M).where("l_pin < r_pin")
    p = p.where((F.col("d") <= NAME_M) | F.col("l_campus"))
    small = lambda a, b: N.is_subset(F.col(f"{a}_toks"), F.col(f"{b}_toks")) & (F.col(f"{a}_reviews") < SUBSET_REVIEWS)
    rule = (
        (F.col("d") <= SAME_M)
        | (F.col("l_toks") == F.col("r_toks"))
        | (F.col("l_campus") & (N.shared(F.col("l_words"), F.col("r_words")) >= 2))
        | ((F.col("d") <= NAME_M) & (small("l", "r") | small("r", "l")))
    )
    return p.where(rule).select("l_pin", "r_pin")


def guarded_groups(pairs: DataFrame, pins: DataFrame, separate: DataFrame) -> DataFrame:
    """E5. (pin, grp): transitive groups of the pairs, never with both ends of a `separate` pair (a, b) in one group.

    Pairs are taken in the order of their pins, and one that would bring a separate pair together is refused. Components that
    hold no whole separate pair are as they come; the others are merged anew, in rounds: see `merged_in_order`.
    """
    every = pairs.select(F.col("l_pin").alias("a"), F.col("r_pin").alias("b")).unionByName(pins.where(~F.col("sub")).select(F.col("pin").alias("a"), F.col("pin").alias("b")))
    comp = written(components(every).withColumnsRenamed({"id": "pin", "root": "grp"}), "groups")
    of = lambda n: comp.select(F.col("pin").alias(n), F.col("grp").alias(f"g_{n}")).hint("merge")
    bad = written(separate.join(of("a"), "a").join(of("b"), "b").where("g_a = g_b").select(F.col("g_a").alias("grp"), "a", "b"), "separate")
    touched = bad.select("grp").distinct().hint("merge")
    plain = comp.join(touched, "grp", "left_anti").select("pin", "grp")
    redo = comp.join(touched, "grp", "left_semi").select("pin")
    inside = pairs.select(F.col("l_pin").alias("a"), F.col("r_pin").alias("b")).join(redo.withColumnRenamed("pin", "a").hint("merge"), "a", "left_semi")
    return plain.unionByName(merged_in_order(inside, redo, bad.select("a", "b")))


def merged_in_order(pairs: DataFrame, pins: DataFrame, separate: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(pin, grp) as if the pairs (a, b) were taken one by one in order, each joining its groups unless a pair of `separate` would
    then be in one; grp is the least pin of a group.

    A round decides all pairs that are the least open one of both groups that they join: no earlier pair can change these two
    before, so the decision is that of the sequence. Pairs inside a group are dropped, refused ones never come back, as groups
    only grow. Every round is a few joins on keys; their number is that of the longest chain of decisions that wait for one
    another, at most the pairs of one component.
    """
    groups = written(pins.select("pin", F.col("pin").alias("grp")), "groups")
    live = written(pairs.select("a", "b").where("a <> b").distinct(), "open-pairs")
    for _ in range(max_rounds):
        of = lambda n: groups.select(F.col("pin").alias(n), F.col("grp").alias(f"g{n}")).hint("merge")  # noqa: E731, B023
        ends = lambda df: df.join(of("a"), "a").join(of("b"), "b")  # noqa: E731, B023
        live = written(ends(live.select("a", "b")).where("ga <> gb"), "open-pairs")
        pair = F.struct("a", "b")
        least = live.select(F.col("ga").alias("grp"), pair.alias("p")).unionByName(live.select(F.col("gb").alias("grp"), pair.alias("p"))).groupBy("grp").agg(F.min("p").alias("p"))
        first = lambda n: least.select(F.col("grp").alias(f"g{n}"), F.col("p").alias(f"p{n}")).hint("merge")  # noqa: E731, B023
        apart = ends(separate).select(F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y"), F.lit(True).alias("apart")).distinct()
        ready = live.join(first("a"), "ga").join(first("b"), "gb").where((F.col("pa") == pair) & (F.col("pb") == pair))
        ready = ready.select("a", "b", F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y")).join(apart.hint("merge"), ["x", "y"], "left")
        ready = written(ready, "decided")
        if ready.isEmpty():
            return groups
        joined = ready.where("apart is null").select(F.col("y").alias("grp"), F.col("x").alias("to"))
        groups = written(groups.join(joined.hint("merge"), "grp", "left").select("pin", F.coalesce("to", "grp").alias("grp")), "groups")
        live = live.join(ready.hint("merge"), ["a", "b"], "left_anti")
    raise RuntimeError("merging has not settled")


def score_order(preferred: Column) -> list[Column]:
    """W3. The order in which the representative of a group is picked: named by a reviewer, a whole place, most reviews,
    no specialty, the category's headline noun, an unqualified name, a short name, then the first pin."""
    n = F.col("name")
    return [
        F.desc(preferred), F.asc("sub"), F.desc("reviews"), N.is_specialty(n).asc(), N.anchor_hit(n, F.col("category")).desc(),
        N.has_qualifier(n).asc(), F.length(n).asc(), F.asc("pin"),
    ]


def representatives(groups: DataFrame, pins: DataFrame, preferred: DataFrame) -> DataFrame:
    """W3. pin, grp, rep for every grouped pin. preferred: pin."""
    df = groups.join(pins.hint("merge"), "pin").join(preferred.select("pin", F.lit(True).alias("_p")).distinct().hint("merge"), "pin", "left")
    w = Window.partitionBy("grp").orderBy(*score_order(F.coalesce("_p", F.lit(False))))
    return df.withColumn("rep", F.first("pin").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select("pin", "grp", "rep")


def _edge(child: str, parent: str, source: str) -> list[Column]:
    return [F.col("l_category").alias("category"), F.col(child).alias("child"), F.col(parent).alias("parent"), F.lit(source).alias("source")]


def _not_apart(df: DataFrame, separate: DataFrame) -> DataFrame:
    both = separate.select(F.col("a").alias("l_pin"), F.col("b").alias("r_pin")).unionByName(separate.select(F.col("b").alias("l_pin"), F.col("a").alias("r_pin")))
    return df.join(both.distinct().hint("merge"), ["l_pin", "r_pin"], "left_anti")


def satellites(reps: DataFrame, separate: DataFrame, preferred: DataFrame) -> DataFrame:
    """E6. Campus representatives with few reviews go to the nearest stronger one within 500 m that shares a word."""
    camp = reps.where("campus")
    weak = camp.where(F.col("reviews") < SATELLITE_REVIEWS).join(preferred.select("pin").distinct().hint("merge"), "pin", "left_anti")
    p = _not_apart(near_sharing(weak, camp, "full", "full", SATELLITE_M).where("r_reviews > l_reviews"), separate)
    best = p.groupBy("l_pin", "l_category").agg(F.min(F.struct("d", "r_pin")).alias("b"))
    return best.select(F.col("l_category").alias("category"), F.col("l_pin").alias("child"), F.col("b.r_pin").alias("parent"), F.lit("name").alias("source"))


def sub_parts(pins: DataFrame, reps: DataFrame, separate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E7. (edges, orphans): a sub-part goes to the most reviewed representative within 400 m that shares a telling word;
    one without a telling word of its own to the nearest. The others are orphans."""
    subs = pins.where("sub")
    p = _not_apart(near_pairs(subs, reps, SUB_M), separate)
    named = F.size("l_dsub") > 0
    ok = p.where(~named | F.arrays_overlap("l_dsub", "r_dist"))
    rank = F.when(named, F.struct((-F.col("r_reviews")).cast("double").alias("k"), "r_pin")).otherwise(F.struct(F.col("d").alias("k"), "r_pin"))
    best = ok.groupBy("l_pin", "l_category").agg(F.min(rank).alias("b"))
    edges = best.select(F.col("l_category").alias("category"), F.col("l_pin").alias("child"), F.col("b.r_pin").alias("parent"), F.lit("name").alias("source"))
    return edges, subs.join(edges.select(F.col("child").alias("pin")).hint("merge"), "pin", "left_anti")


def footprint_edges(standing: DataFrame, covering: DataFrame, separate: DataFrame, preferred: DataFrame) -> DataFrame:
    """E8. Pins in one footprint are one place. covering: pin, fid, fname, area (deg2).

    Each pin takes the covering footprint that shares most telling words with it, then the smallest; of the pins of a
    footprint the reviewer's choice stays, else most shared words, most reviews. A pin that must stay apart from the one
    that stays isn't folded.
    """
    c = covering.join(standing.hint("merge"), "pin").withColumn("fdist", N.distinctive(F.col("fname"))).withColumn("overlap", N.shared(F.col("dist"), F.col("fdist")))
    own = Window.partitionBy("pin").orderBy(F.desc("overlap"), "area", "fid")
    c = c.withColumn("_n", F.row_number().over(own)).where("_n = 1")
    c = c.join(preferred.select("pin", F.lit(True).alias("_p")).distinct().hint("merge"), "pin", "left")
    rank = Window.partitionBy("category", "fid").orderBy(F.coalesce("_p", F.lit(False)).desc(), F.desc("overlap"), F.desc("reviews"), "pin")
    c = c.withColumn("head", F.first("pin").over(rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    p = c.where("pin <> head").select(F.col("category").alias("l_category"), F.col("pin").alias("l_pin"), F.col("head").alias("r_pin"))
    return _not_apart(p, separate).select(*_edge("l_pin", "r_pin", "osm"))


def container_edges(standing: DataFrame, covering: DataFrame, separate: DataFrame, preferred: DataFrame) -> DataFrame:
    """E9. Park pins inside a large park's footprint go to its flagship: the pin in it that shares a telling word with
    its name and has most reviews. The smallest such footprint counts. covering: pin, fid, fname, m2."""
    c = covering.where(F.col("m2").between(*CONTAINER_M2)).join(standing.where("category = 'park'").hint("merge"), "pin")
    c = c.join(preferred.select("pin", F.lit(True).alias("_p")).distinct().hint("merge"), "pin", "left").withColumn("fdist", N.distinctive(F.col("fname")))
    flag = c.where(F.arrays_overlap("dist", "fdist")).groupBy("fid").agg(F.max_by("pin", F.struct(F.coalesce("_p", F.lit(False)), "reviews", -F.col("pin"))).alias("flag"))
    held = c.join(flag.hint("merge"), "fid")
    # From the smallest footprint up: at its own flagship a pin stops; a flagship it must stay apart from is passed over.
    both = separate.select(F.col("a").alias("pin"), F.col("b").alias("flag")).unionByName(separate.select(F.col("b").alias("pin"), F.col("a").alias("flag"))).distinct()
    held = held.join(both.withColumn("_apart", F.lit(True)).hint("merge"), ["pin", "flag"], "left").where("_apart is null")
    w = Window.partitionBy("pin").orderBy("m2", "fid")
    held = held.withColumn("_n", F.row_number().over(w)).where("_n = 1 and pin <> flag")
    return held.select("category", F.col("pin").alias("child"), F.col("flag").alias("parent"), F.lit("bigpark").alias("source"))


def fold_edges(standing: DataFrame, covering: DataFrame, separate: DataFrame, preferred: DataFrame) -> DataFrame:
    """E10. A park pin named like an amenity goes to the nearest real park pin that shares a word other than a weak one,
    within the reach that the parent's footprint or name gives it."""
    m2 = covering.groupBy("pin").agg(F.min("m2").alias("m2"))
    df = standing.where("category = 'park'").join(m2.hint("merge"), "pin", "left").join(preferred.select("pin", F.lit(True).alias("_p")).distinct().hint("merge"), "pin", "left")
    weak = F.array(*[F.lit(w) for w in N.FOLD_WEAK])
    df = df.withColumns({"strong": F.array_except("dist", weak), "_sub": F.col("name").rlike("(?iU)" + N.PARK_SUBFEATURE) & F.col("_p").isNull(), "m2": F.coalesce("m2", F.lit(0.0))})
    reach = (
        F.when((F.col("m2") >= FOLD_M2["sparse"]) | F.col("name").rlike("(?iU)" + N.PARK_SPARSE), FOLD_M["sparse"])
        .when(F.col("m2") >= FOLD_M2["mid"], FOLD_M["mid"])
        .otherwise(FOLD_M["urban"])
    )
    df = df.withColumn("reach", reach)
    p = near_sharing(df.where("_sub"), df.where("not _sub"), "strong", "strong", FOLD_M["sparse"]).where("d <= r_reach")
    best = p.groupBy("l_pin", "l_category").agg(F.min(F.struct("d", (-F.col("r_reviews")).alias("k"), "r_pin")).alias("b"))
    best = best.select("l_category", "l_pin", F.col("b.r_pin").alias("r_pin"))
    return _not_apart(best, separate).select(*_edge("l_pin", "r_pin", "bigpark"))


def with_manual(edges: DataFrame, manual: DataFrame) -> DataFrame:
    """E11. manual: category, child, parent, ord. A reviewer's parent, followed to its current root, replaces what the
    rules found for the child. Of several entries for a child the last counts. An entry whose root is the child itself is
    left out."""
    root = roots(edges).withColumnsRenamed({"id": "parent"})
    m = manual.join(root.hint("merge"), "parent", "left").withColumn("root", F.coalesce("root", "parent")).where("root <> child")
    m = m.groupBy("category", "child").agg(F.max_by("root", "ord").alias("parent")).withColumn("source", F.lit("manual"))
    return edges.join(m.select("child").distinct().hint("merge"), "child", "left_anti").select("category", "child", "parent", "source").unionByName(m.select("category", "child", "parent", "source"))


def containing(holders: DataFrame, parts: DataFrame) -> DataFrame:
    """(h, p) of all pairs of one category where the text of the holder (category, h, text) contains that of the part
    (category, p, text; not empty). Parts meet holders on that run of three characters of theirs which fewest holders have
    (all of a shorter text), so no category is paired with itself as a whole."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - (n - 1), F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(n)))
    held = holders.select("category", "h", F.col("text").alias("_held"), F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))).alias("_run"))
    rare = held.groupBy("category", "_run").agg(F.count("*").alias("_n"))
    asked = parts.where("text <> ''").select("category", "p", "text", F.explode(F.array_distinct(runs(3))).alias("_run"))
    key = asked.join(rare.hint("merge"), ["category", "_run"]).groupBy("category", "p").agg(F.min(F.struct("_n", "_run", "text")).alias("_k"))
    met = key.select("category", "p", F.col("_k._run").alias("_run"), F.col("_k.text").alias("text")).join(held.hint("merge"), ["category", "_run"])
    return met.where(F.contains("_held", "text")).select("h", "p")


def resolve_overrides(pins: DataFrame, overrides: DataFrame, meters: float = 200.0) -> tuple[DataFrame, DataFrame]:
    """J14. overrides: ord, category, query, lat, lon (null unless pinned). (resolved: ord, pin; unresolved: ord, query).

    Names are compared normalised: exact matches win, else either name may contain the other. A pinned override takes the
    nearest match within `meters`, any other the most reviewed.
    """
    p = pins.withColumn("norm", N.match_norm(F.col("name"))).select("pin", "category", "norm", F.coalesce("reviews", F.lit(0)).alias("reviews"), "lat", "lon")
    o = overrides.select("ord", "category", N.match_norm(F.col("query")).alias("q"), "lat", "lon")
    # Pins of one name are one row with the most reviewed of them, overrides of one query another, so names meet and not pins.
    first = F.struct((-F.col("reviews")).alias("k"), "pin")
    a = written(p.where("norm is not null").groupBy("category", F.col("norm").alias("text")).agg(F.min(first).alias("best")), "names")
    b = written(o.where("q is not null").select("category", F.col("q").alias("text")).distinct(), "queries")
    # The four ways to match: equal, either contains the other, and a nameless pin, which every name contains.
    both = F.struct("category", "text")
    held, asked = a.select("category", "text", both.alias("h"), both.alias("p")), b.select("category", "text", both.alias("h"), both.alias("p"))
    same = b.join(a.select("category", "text").hint("merge"), ["category", "text"]).select("category", F.col("text").alias("q"), "text")
    inside = containing(held.drop("p"), asked.drop("h")).select("p.category", F.col("p.text").alias("q"), F.col("h.text").alias("text"))
    around = containing(asked.drop("p"), held.drop("h")).select("h.category", F.col("h.text").alias("q"), F.col("p.text").alias("text"))
    nameless = a.where("text = ''").select("category", "text").join(b.where("text <> ''").select("category", F.col("text").alias("q")).hint("merge"), "category").select("category", "q", "text")
    names = same.unionByName(inside).unionByName(around).unionByName(nameless).where(F.col("text").isNotNull())
    most = F.min(F.struct((F.col("q") != F.col("text")).alias("other"), "best.k", "best.pin")).alias("b")
    found = names.join(a.hint("merge"), ["category", "text"]).groupBy("category", "q").agg(most)
    free = o.where("lat is null").join(found.hint("merge"), ["category", "q"]).select("ord", F.struct("b.other", F.lit(0.0).alias("d"), "b.k", "b.pin").alias("b"))
    # A pinned one looks at the pins around it only; where its name is that of any pin, only such pins count.
    known = a.select("category", F.col("text").alias("q"), F.lit(True).alias("known"))
    pinned = o.where("lat is not null and q is not null").join(known.hint("merge"), ["category", "q"], "left")
    from .joins import within

    x, q, c = F.col("l_norm"), F.col("r_q"), F.col
    near = within(p, pinned, meters, by=["category"], copy="right")
    near = near.where(F.when(c("r_known"), x == q).otherwise((q != "") & F.contains(x, q) | F.contains(q, x)))
    near = near.select(c("r_ord").alias("ord"), F.struct((x != q).alias("other"), "d", (-c("l_reviews")).alias("k"), c("l_pin").alias("pin")).alias("b"))
    got = free.unionByName(near).groupBy("ord").agg(F.min("b").alias("b")).select("ord", "b.pin")
    return got, overrides.join(got.select("ord").hint("merge"), "ord", "left_anti").select("ord", "query")


def resolve_pois(pins: DataFrame, covering: DataFrame, manual: DataFrame, separate: DataFrame, drops: DataFrame, campus: tuple[str, ...] = CAMPUS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """E14. (kept pins, edges, funnel by category). covering: pin, fid, fname, area, m2 of the footprints that cover a pin.

    P9 and P10 first; then E4-E7 by name, E8 by footprint, E9 and E10 in parks, E11 by hand; drops (pin) go last with
    the edges that touch them (E13).
    """
    bad = N.auto_dropped(F.col("category"), F.col("name")) | (F.coalesce("status", F.lit("")) == "CLOSED_PERMANENTLY")
    p = written(described(pins.where(~bad), campus), "pins")
    named = manual.select(F.col("parent").alias("pin")).distinct().join(manual.select(F.col("child").alias("pin")).hint("merge"), "pin", "left_anti")
    groups = guarded_groups(merge_pairs(p), p, separate)
    reps = written(representatives(groups, p, named), "reps")
    cats = p.select(F.col("pin").alias("child"), "category")
    e1 = reps.where("pin <> rep").select(F.col("pin").alias("child"), F.col("rep").alias("parent"), F.lit("name").alias("source")).join(cats.hint("merge"), "child").select("category", "child", "parent", "source")
    heads = p.join(reps.where("pin = rep").select("pin").hint("merge"), "pin")
    e2 = written(satellites(heads, separate, named), "satellites")
    heads = heads.join(e2.select(F.col("child").alias("pin")).hint("merge"), "pin", "left_anti")
    e3, orphans = sub_parts(p, heads, separate)
    standing = written(heads.unionByName(orphans), "standing")
    e4 = written(footprint_edges(standing, covering, separate, named), "footprints")
    left = standing.join(e4.select(F.col("child").alias("pin")).hint("merge"), "pin", "left_anti")
    e5 = written(container_edges(left, covering, separate, named), "containers")
    left = left.join(e5.select(F.col("child").alias("pin")).hint("merge"), "pin", "left_anti")
    e6 = fold_edges(left, covering, separate, named)
    auto = e1.unionByName(e2).unionByName(e3).unionByName(e4).unionByName(e5).unionByName(e6)
    gone = drops.select("pin").distinct()
    edges = with_manual(written(auto, "auto-edges"), manual)
    for end in ("child", "parent"):
        edges = edges.join(gone.withColumnRenamed("pin", end).hint("merge"), end, "left_anti")
    edges = written(edges.select("category", "child", "parent", "source"), "edges-found")
    kept = standing.join(edges.select(F.col("child").alias("pin")).hint("merge"), "pin", "left_anti").join(gone.hint("merge"), "pin", "left_anti")
    n = edges.groupBy("category").pivot("source", ["name", "osm", "bigpark", "manual"]).count().na.fill(0)
    funnel = p.groupBy("category").agg(F.count("*").alias("pins")).join(kept.groupBy("category").agg(F.count("*").alias("kept")), "category", "left").join(n, "category", "left").na.fill(0)
    return kept.select(*pins.columns), edges, funnel


def renamed(pins: DataFrame, renames: DataFrame) -> DataFrame:
    """E13. renames: pin, new_name, new_lat, new_lon. Pins with a row there take its name, and its place where both
    coordinates are given; of several rows for a pin the first by name counts."""
    one = renames.groupBy("pin").agg(F.min(F.struct("new_name", "new_lat", "new_lon")).alias("_to"))
    moved = F.col("_to.new_lat").isNotNull() & F.col("_to.new_lon").isNotNull()
    at = {n: F.when(moved, F.col(f"_to.new_{n}")).otherwise(F.col(n)) for n in ("lat", "lon")}
    return pins.join(one, "pin", "left").withColumns({"name": F.coalesce("_to.new_name", "name"), **at}).select(*pins.columns)


def children(edges: DataFrame, pins: DataFrame) -> DataFrame:
    """A17, S15. For each final representative its pins, most reviews first."""
    r = roots(edges).withColumnsRenamed({"id": "pin", "root": "rep"}).join(pins.select("pin", "name", "reviews"), "pin")
    kids = F.array_sort(F.collect_list(F.struct((-F.coalesce("reviews", F.lit(0))).alias("k"), "pin", "name")))
    return r.groupBy("rep").agg(F.transform(kids, lambda x: F.struct(x["pin"].alias("pin"), x["name"].alias("name"))).alias("kids"))


def evaluate(auto: DataFrame, target: DataFrame, separate: DataFrame) -> DataFrame:
    """V1. auto, target: pin, grp. How many wanted merges were caught or missed, how many pairs were merged too much,
    and how many separate pairs (a, b) share a group.

    Pairs are counted, not made: n (n - 1) / 2 of each group and of each meeting of an auto with a target group.
    """
    n = F.col("n")
    pairs = lambda df, name, *by: df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0).cast("long")).alias(name))
    both = auto.select("pin", F.col("grp").alias("auto")).join(target.select("pin", F.col("grp").alias("want")), "pin")
    of = lambda c: auto.select(F.col("pin").alias(c), F.col("grp").alias(f"g{c}"))
    s = separate.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    together = s.join(of("a"), "a").join(of("b"), "b").agg(F.count_if(F.col("ga") == F.col("gb")).alias("violations"))
    one = pairs(both, "caught", "auto", "want").crossJoin(pairs(target, "wanted", "grp")).crossJoin(pairs(auto, "merged", "grp")).crossJoin(together)  # one row each
    return one.select("caught", (F.col("wanted") - F.col("caught")).alias("missed"), (F.col("merged") - F.col("caught")).alias("over_merged"), "violations")


def pair_diagnostics(pairs: DataFrame, pins: DataFrame) -> DataFrame:
    """V2. a, b -> distance, shared words, whether either is a sub-part."""
    d = described(pins).select("pin", "lat", "lon", "dist", "sub")
    a, b = _sides(d, "a_").withColumnRenamed("a_pin", "a"), _sides(d, "b_").withColumnRenamed("b_pin", "b")
    j = pairs.join(a, "a").join(b, "b")
    return j.select("a", "b", geo.haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")).alias("d"), F.array_sort(F.array_intersect("a_dist", "b_dist")).alias("shared"), (F.col("a_sub") | F.col("b_sub")).alias("sub"))
