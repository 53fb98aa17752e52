"""Entity resolution: blocks, similarity, leader clusters, gold products.

Rows of a block join, in order of arrival, the first cluster whose first
member is similar enough, else they open a cluster.  The result equals the
lexicographically first maximal independent set ("leaders") of the similarity
graph, every other row joining its earliest similar leader.  That form needs
no sequential pass, and it is computed without pairing up whole blocks:

* titles are reduced to their distinct compared forms per block, so copies of
  a listing cost nothing;
* each form is filed under pairs of its rarest character grams, with the places
  they stand in (or under its rarest words): two similar forms always share at
  least one file, by the prefix-filter argument, and there the edits that the
  places of both grams call for stay within the budget of the two lengths;
  a block with fewer forms than a form has pairs of grams is one file;
* a round looks at the earliest undecided forms of each file, decides those
  whose earlier rivals are all known, and compares the new leaders with the
  rest of the file.  A file full of near copies collapses onto its first leader
  in the first round instead of being paired up.

A file has a row of six numbers per form; titles are fetched once for each
pair that meets in any file with fitting lengths and places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.similarity import (
    lcs_length,
    ratio_reaches,
    sorted_tokens,
    token_set,
    tokens,
)
from shelfscope.functions.stats import attach
from shelfscope.functions.text import normalize_title
from shelfscope.session import materialise

THRESHOLD = 85  # fixed value: similarity from which two titles are one product

BLOCK = ["block_category", "block_quantity", "block_unit"]
TOGETHER = 4  # grams of the alignment of two similar forms that both are filed under in pairs
FIRST_HEADS = 64  # undecided forms per file looked at in the first round; results do not depend on it
SMALL_BLOCK = 64  # forms of a block up to which they are one file: fewer pairs a form than it has pairs of grams


def block_key(listings: DataFrame) -> DataFrame:
    """Add the three columns on which two listings must agree to be compared."""
    return listings.withColumns(
        {
            "block_category": F.lower(F.coalesce("category", F.lit("Unknown"))),
            "block_quantity": F.coalesce("quantity", F.lit(1.0)),
            "block_unit": F.lower(F.coalesce("unit", F.lit("unit"))),
        }
    )


def compared_form(name: Column, method: str) -> Column:
    """What of a title is compared: its sorted words, or its set of words."""
    title = normalize_title(name)
    return {"token_sort": sorted_tokens, "jaccard": token_set}[method](title)


# --- files: signatures that similar forms must share ------------------------


def gram_length(threshold: int) -> int:
    """Longest gram (up to 3) for which similar forms always share one.

    With ratio t, forms of lengths a <= b differ by at most the deletions and
    insertions that lengths in [a, a(2-t)/t] allow; the bound on shared padded
    grams must not fall with the length.
    """
    t = threshold / 100
    for q in (3, 2):
        longest = 1 - q * (1 - t / (2 - t))
        shortest = 1 - (q - 1) * ((2 - t) / t - 1)
        if min(longest, shortest) >= 0:
            return q
    return 1


def _shared_grams_at_least(length: Column, threshold: int, q: int) -> Column:
    """Fewest padded grams a form shares with any form that reaches the threshold."""
    t = threshold / 100
    dropped = length * (1 - t / (2 - t))  # partner as short as possible: only deletions
    added = length * ((2 - t) / t - 1)  # partner as long as possible: only insertions
    whole = length + (q - 1)
    bound = F.least(whole - q * dropped, whole - (q - 1) * added)
    return F.greatest(F.ceil(bound - 1e-9), F.lit(1))


def _padded_grams(form: Column, q: int) -> Column:
    """The grams of a form with ``q - 1`` fill characters on both sides, in order."""
    pad = F.lit("_" * (q - 1))
    padded = F.concat(pad, form, pad)
    return F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substr(padded, i, F.lit(q)))


def _file_together(forms: DataFrame, threshold: int) -> DataFrame:
    """Forms of small blocks with one file for the whole block, and the grams that pairs are tested on."""
    spread = forms.filter(F.col("form") != "").withColumn(
        "_grams", F.array_sort(_padded_grams(F.col("form"), gram_length(threshold)))
    )
    every = F.transform("_grams", lambda g, i: F.xxhash64(g, i - F.array_position("_grams", g)))
    block = F.struct(F.lit(0).cast("long").alias("file"), F.lit(0).alias("p1"), F.lit(0).alias("p2"))
    return spread.select(*forms.columns, F.array(block).alias("files"), F.lit(1).alias("together"), every.alias("grams"))


def _file_under_grams(forms: DataFrame, threshold: int) -> DataFrame:
    """Forms under pairs of their rarest grams, with the places of both.

    Under the best alignment of two similar forms at least c grams stay whole,
    c the larger of their bounds.  The first m <= c of those stand among the
    first n - bound + m of either form in the global order, so the forms share
    all pairs of these, at places that the alignment puts on each other.  Forms
    with a bound of 1 may share a single gram and are filed under each as well.
    A gram that stands several times is filed with each of its places.
    """
    q = gram_length(threshold)
    gram = _padded_grams(F.col("form"), q)
    spread = forms.filter(F.col("form") != "")
    grams = spread.select("ord", F.length("form").alias("len"), F.posexplode(gram).alias("at", "gram"))
    rarity = materialise(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")))
    ranked = (
        grams.join(rarity, "gram")
        .groupBy("ord", "len")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "gram", "at"))).alias("_all"))  # of one title
    )
    ranked = ranked.withColumn("_grams", F.col("_all.gram"))
    ranked = ranked.withColumn(
        "_all",
        F.transform(
            "_all",
            lambda s, i: F.struct(
                F.xxhash64(s["gram"]).alias("gram"), s["at"].alias("at"), (i - F.array_position("_grams", s["gram"])).alias("copy")
            ),
        ),
    )
    bound = _shared_grams_at_least(F.col("len"), threshold, q)
    together = F.least(bound, F.lit(TOGETHER))
    begin = F.size("_all") - bound + F.greatest(together, F.lit(2))
    first = F.slice("_all", F.lit(1), F.least(F.size("_all"), begin).cast("int"))
    ranked = ranked.select(
        "ord",
        bound.alias("_bound"),
        together.cast("int").alias("together"),
        F.transform("_all", lambda s: F.xxhash64(s["gram"], s["copy"])).alias("_every"),
        "_all",
        first.alias("_rare"),
    )

    def place(x: Column, y: Column, key: Column) -> Column:
        return F.struct(key.alias("file"), x["at"].alias("p1"), y["at"].alias("p2"))

    rare = F.col("_rare")
    pairs = F.flatten(
        F.transform(
            rare,
            lambda x, i: F.transform(
                F.slice(rare, i + 2, F.size(rare)), lambda y: place(x, y, F.xxhash64(x["gram"], y["gram"]))
            ),
        )
    )
    none = F.slice(pairs, 1, 0)
    singles = F.when(F.col("_bound") < 2, F.transform("_all", lambda x: place(x, x, x["gram"]))).otherwise(none)
    return ranked.select("ord", F.concat(pairs, singles).alias("files"), "together", F.col("_every").alias("grams"))


def _file_under_words(forms: DataFrame, threshold: int) -> DataFrame:
    words = forms.select("ord", F.explode(tokens(F.col("form"))).alias("word"))
    rarity = materialise(words.groupBy("word").agg(F.count(F.lit(1)).alias("_n")))
    ranked = (
        words.join(rarity, "word")
        .groupBy("ord")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "word"))).alias("_all"))
    )
    shared = F.ceil(F.size("_all") * (threshold / 100) - 1e-9)
    kept = F.size("_all") - F.greatest(shared, F.lit(1)) + 1
    rarest = F.slice("_all", F.lit(1), kept.cast("int"))
    files = F.transform(
        rarest,
        lambda s: F.struct(
            F.xxhash64(s["word"]).alias("file"), F.lit(0).alias("p1"), F.lit(0).alias("p2")
        ),
    )
    none = F.array().cast("array<bigint>")
    return ranked.select("ord", files.alias("files"), F.lit(1).alias("together"), none.alias("grams"))


# --- similar pairs -----------------------------------------------------------


def _similar(pairs: DataFrame, method: str, threshold: int) -> DataFrame:
    """Keep the candidate pairs (early, late) that reach the threshold."""
    a, b = F.col("early_form"), F.col("late_form")
    if method == "jaccard":
        left, right = tokens(a), tokens(b)
        hit = 100 * F.size(F.array_intersect(left, right)) >= threshold * F.size(F.array_union(left, right))
        return pairs.filter(hit).select("early", "late")
    scored = pairs.withColumn("_lcs", lcs_length(a, b))
    return scored.filter(ratio_reaches(F.col("_lcs"), a, b, threshold)).select("early", "late")


def _edits(a: Column, b: Column, threshold: int) -> tuple[Column, Column]:
    """The most deletions from forms of lengths ``a`` and insertions up to lengths ``b`` that similar ones can need."""
    common = F.ceil(threshold * (a + b) / 200 - 1e-9)
    return a - common, b - common


def _fits(threshold: int) -> Column:
    """Whether lengths and places of two rows of a file allow similar forms.

    What stands before the first gram, between the two and behind the second
    needs as many edits at least as it differs in length.
    """
    a, b = F.col("e.len"), F.col("l.len")
    deleted, inserted = _edits(a, b, threshold)
    first, second = (F.col(f"l.{p}") - F.col(f"e.{p}") for p in ("p1", "p2"))
    in_order = F.col("e.p1") <= F.col("e.p2")
    before, behind = F.when(in_order, first).otherwise(second), F.when(in_order, second).otherwise(first)
    needed = F.abs(before) + F.abs(behind - before) + F.abs(b - a - behind)
    same_order = in_order == (F.col("l.p1") <= F.col("l.p2"))
    return (200 * F.least(a, b) >= threshold * (a + b)) & same_order & (needed <= deleted + inserted)


def _candidates(early: DataFrame, late: DataFrame, forms: DataFrame, method: str, threshold: int) -> DataFrame:
    """Pairs (early, late) of a block that share a file, have fitting lengths and places and enough common grams, each once."""
    e, l = early.alias("e"), late.alias("l")
    test = (F.col("e.file") == F.col("l.file")) & (F.col("e.ord") < F.col("l.ord"))
    if method == "token_sort":
        test = test & _fits(threshold)
    # Forms that share the first grams of their alignment meet in all pairs of these.
    together = F.least("e.together", "l.together")
    files = F.greatest((together * (together - 1) / 2).cast("int"), F.lit(1))
    met = (
        e.join(l, test)
        .groupBy(F.col("e.ord").alias("early"), F.col("l.ord").alias("late"), files.alias("_files"))
        .count()
        .filter(F.col("count") >= F.col("_files"))
    )

    def side(name: str) -> DataFrame:
        return forms.select(
            F.col("ord").alias(name), F.col("form").alias(f"{name}_form"), F.struct(*BLOCK).alias(f"{name}_block"),
            F.col("grams").alias(f"{name}_grams"),
        )

    # A file is a hash of block and grams: the block itself is compared here.
    found = (
        met.join(side("early"), "early")
        .join(side("late"), "late")
        .filter(F.col("early_block").eqNullSafe(F.col("late_block")))
    )
    if method == "token_sort":
        # A deletion breaks up to q grams of the form it is made in, an insertion one less.
        q = gram_length(threshold)
        a, b = F.length("early_form"), F.length("late_form")
        deleted, inserted = _edits(a, b, threshold)
        whole = [a + (q - 1) - q * deleted - (q - 1) * inserted, b + (q - 1) - q * inserted - (q - 1) * deleted]
        found = found.filter(F.size(F.array_intersect("early_grams", "late_grams")) >= F.greatest(*whole))
    return found.select("early", "early_form", "late", "late_form")


def similar_titles(rows: DataFrame, threshold: int = THRESHOLD, method: str = "token_sort") -> DataFrame:
    """All pairs (early, late) of distinct compared forms of a block that reach the threshold.

    ``rows`` carry the block columns, ``ord`` and ``form``.  For reports; the
    clustering below never needs every pair.
    """
    filed, forms = _file(_distinct_forms(rows), threshold, method)
    return _similar(_candidates(filed, filed, forms, method, threshold), method, threshold)


# --- leader clusters ----------------------------------------------------------

UNDECIDED, LEADER, MEMBER = 0, 1, 2


def _distinct_forms(rows: DataFrame) -> DataFrame:
    return materialise(rows.groupBy(*BLOCK, "form").agg(F.min("ord").alias("ord")))


def _file(forms: DataFrame, threshold: int, method: str) -> tuple[DataFrame, DataFrame]:
    """A row for every file of every form, with its length and the places; and the forms with what pairs are tested on."""
    if method == "token_sort":
        block = F.xxhash64(*BLOCK)  # holds for missing values too; blocks of one hash count as one
        placed = forms.withColumn("_block", block)
        sizes = placed.groupBy("_block").agg((F.count(F.lit(1)) <= SMALL_BLOCK).alias("_small"))
        placed = materialise(attach(placed, sizes, ["_block"]))
        small, large = (placed.filter(which).select(*forms.columns) for which in ("_small", "not _small"))
        known = _file_together(small, threshold).unionByName(large.join(_file_under_grams(large, threshold), "ord"))
    else:
        known = forms.join(_file_under_words(forms, threshold), "ord")
    known = materialise(known)
    filed = known.select(
        F.explode("files").alias("_f"), *BLOCK, "ord", F.length("form").alias("len"), "together", F.size("files").alias("n_files")
    ).select(F.xxhash64(*BLOCK, "_f.file").alias("file"), "ord", "len", "_f.p1", "_f.p2", "together", "n_files")
    return materialise(filed), known.select(*BLOCK, "form", "ord", "grams")


def _decide(heads: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """Status of the heads after every decision their known edges allow, and how many wait.

    A complete head with no earlier similar undecided head or leader leads; a
    head with an earlier similar leader is a member.
    """
    nodes = heads.groupBy("ord").agg(
        (F.count(F.lit(1)) == F.max("n_files")).alias("complete"),
        F.lit(UNDECIDED).alias("status"),
    )
    while True:
        blockers = (
            edges.join(nodes.select(F.col("ord").alias("early"), F.col("status").alias("_early")), "early")
            .filter(F.col("_early") != MEMBER)
            .groupBy(F.col("late").alias("ord"))
            .agg(F.max("_early").alias("_blocked"))
        )
        joined = nodes.join(blockers, "ord", "left")
        status = (
            F.when(F.col("status") != UNDECIDED, F.col("status"))
            .when(F.col("_blocked") == LEADER, F.lit(MEMBER))
            .when(F.col("complete") & F.col("_blocked").isNull(), F.lit(LEADER))
            .otherwise(F.lit(UNDECIDED))
        )
        step = materialise(
            joined.select("ord", "complete", status.alias("status"), (status != F.col("status")).alias("_moved"))
        )
        nodes = step.drop("_moved")
        moved, waiting = step.agg(
            F.count_if(F.col("_moved")), F.count_if(F.col("status") == UNDECIDED)
        ).first()
        if moved == 0 or waiting == 0:
            return nodes, waiting


def _leaders_of_forms(forms: DataFrame, threshold: int, method: str, heads_per_file: int) -> DataFrame:
    """(ord, leader) of every distinct form that is filed anywhere."""
    filed, forms = _file(forms, threshold, method)
    active, others, status = filed, None, None
    leaders: list[DataFrame] = []
    matches: list[DataFrame] = []
    # Up to this limit Spark applies a rank limit before the shuffle, so that a
    # hot file sends at most so many rows per task.
    most = int(filed.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    m = min(heads_per_file, most)
    while True:
        place = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
        heads = materialise(active.withColumn("_place", place).filter(F.col("_place") <= m).drop("_place"))
        edges = materialise(_similar(_candidates(heads, heads, forms, method, threshold), method, threshold))
        nodes, waiting = _decide(heads, edges)
        new = nodes.filter(F.col("status") == LEADER).select("ord")
        leaders.append(new)
        found = edges.join(new.withColumnRenamed("ord", "early"), "early", "left_semi")
        whole = heads.count() == active.count()
        if whole and waiting == 0 and others is None:
            matches.append(found)  # every file fitted: the usual end, after one round
            break

        # All rows of every form that is not wholly among the heads: what it
        # shares with a leader is counted over all its files.
        outside = active.join(heads.select("file", "ord"), ["file", "ord"], "left_anti").select("ord").distinct()
        rest = active.join(outside, "ord", "left_semi")
        if others is not None:
            rest = rest.unionByName(others)
        # New leaders against the forms that were not heads; both sides are
        # written tables, so that a join on a hot file can be split.
        rest = materialise(rest)
        lead = heads.join(new, "ord", "left_semi")
        lead = materialise(lead.join(rest.select("file").distinct(), "file", "left_semi"))
        later = _similar(_candidates(lead, rest, forms, method, threshold), method, threshold)
        found = materialise(found.unionByName(later))
        matches.append(found)

        decided = nodes.filter(F.col("status") != UNDECIDED).select("ord", "status")
        joined_now = found.select(F.col("late").alias("ord")).distinct().withColumn("status", F.lit(MEMBER))
        decided = decided.unionByName(joined_now)
        status = decided if status is None else status.unionByName(decided)
        status = materialise(status.groupBy("ord").agg(F.min("status").alias("status")))
        active = materialise(filed.join(status, "ord", "left_anti"))
        if active.isEmpty():
            break
        # Members stay in their files: a later leader may come before theirs.
        others = filed.join(status.filter(F.col("status") == MEMBER), "ord", "left_semi")
        m = min(m * 4, most)

    own = reduce(DataFrame.unionByName, leaders).select("ord", F.col("ord").alias("leader"))
    first = reduce(DataFrame.unionByName, matches).groupBy(F.col("late").alias("ord")).agg(
        F.min("early").alias("leader")
    )
    return own.unionByName(first)


def _fold_by_shared_words(forms: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Forms of which only the first is clustered for all that differ in words of their own; and (ord, first) of every form.

    A word that stands in one form of its block is common to no pair, so forms
    with equal other words, as many in all, are equally similar to any third
    form and all to each other.  Where they reach the threshold, whatever leads
    the first of them (itself included) is the earliest leader of them all.
    """
    words = forms.select(*BLOCK, "ord", F.explode(tokens(F.col("form"))).alias("word"))
    own = words.groupBy(*BLOCK, "word").agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("ord")).filter(F.col("_n") == 1)
    own = own.groupBy("ord").agg(F.collect_set("word").alias("_own"))  # of one title
    every, none = F.array_distinct(tokens(F.col("form"))), F.array().cast("array<string>")
    shared = F.array_except(every, F.coalesce("_own", none))
    split = forms.join(own, "ord", "left").select(
        *forms.columns, F.array_join(shared, " ").alias("_shared"), F.size(shared).alias("_s"), F.size(every).alias("_words")
    )
    alike = 100 * F.col("_s") >= threshold * (2 * F.col("_words") - F.col("_s"))
    split = materialise(split.withColumn("_alike", alike))
    kind = [*BLOCK, "_shared", "_words"]
    firsts = materialise(split.filter("_alike").groupBy(*kind).agg(F.min(F.struct("ord", "form")).alias("_first")))
    apart = split.filter("not _alike")
    kept = firsts.select(*BLOCK, "_first.form", "_first.ord").unionByName(apart.select(*BLOCK, "form", "ord"))
    placed = split.filter("_alike").join(firsts, kind).select("ord", F.col("_first.ord").alias("first"))
    return kept, placed.unionByName(apart.select("ord", F.col("ord").alias("first")))


def leader_clusters(
    rows: DataFrame,
    threshold: int = THRESHOLD,
    method: str = "token_sort",
    heads_per_file: int = FIRST_HEADS,
) -> DataFrame:
    """Leader of every distinct compared form: block columns, form, ord, leader, leader_form.

    ``rows`` carry the block columns, ``ord`` and ``form``.  Forms without
    words are one cluster under token-sort (two empty titles are equal) and are
    left out under Jaccard, where an empty title resembles nothing.
    """
    forms = _distinct_forms(rows)
    worded = forms.filter(F.col("form") != "")
    if method == "jaccard":
        kept, placed = _fold_by_shared_words(worded, threshold)
        led = _leaders_of_forms(materialise(kept), threshold, method, heads_per_file)
        led = attach(placed, led.withColumnRenamed("ord", "first"), ["first"]).select("ord", "leader")
    else:
        led = _leaders_of_forms(worded, threshold, method, heads_per_file)
        led = led.unionByName(
            forms.filter(F.col("form") == "").select("ord", F.col("ord").alias("leader"))
        )
    leader_forms = forms.select(F.col("ord").alias("leader"), F.col("form").alias("leader_form"))
    return forms.join(led, "ord").join(leader_forms, "leader").select(
        *BLOCK, "form", "ord", "leader", "leader_form"
    )


def assign_leaders(
    rows: DataFrame,
    threshold: int = THRESHOLD,
    method: str = "token_sort",
    heads_per_file: int = FIRST_HEADS,
) -> DataFrame:
    """Rows with the ``leader`` of their form; rows Jaccard leaves out lead themselves."""
    led = leader_clusters(rows, threshold, method, heads_per_file)
    placed = attach(rows, led.select(*BLOCK, "form", "leader"), [*BLOCK, "form"], "left")
    return placed.withColumn("leader", F.coalesce("leader", "ord"))


# --- products ------------------------------------------------------------------


def product_id(*parts: Column) -> Column:
    """Stable id of a cluster from its block and its leader."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def best_offer(rows: DataFrame, product: list[str], facts: bool = True) -> DataFrame:
    """Per product, store and city: the cheapest row (first on ties) and the row facts gold needs.

    Every aggregate combines before the shuffle, so copies of a hot listing
    are folded where they lie.  Without ``facts`` the rows need no name, brand,
    quantity, unit and category: :func:`product_facts` gives gold those.
    """
    cheapest = F.struct(
        F.col("price").isNull().alias("missing"), "price", "ord", "unit_price", "timestamp"
    )
    shortest = F.struct(F.length("name").alias("len"), "ord", "name", "brand", "quantity", "unit", "category")
    return rows.groupBy(*product, "store", "city").agg(
        F.min(cheapest).alias("best"),
        F.min("ord").alias("first_ord"),
        F.count(F.lit(1)).alias("rows"),
        *([F.min(shortest).alias("canonical")] if facts else []),
    )


def product_facts(listed: DataFrame, product: list[str]) -> DataFrame:
    """What gold takes from a list of products, a row for each: the one with the shortest name, and how often it is listed."""
    shortest = F.struct(F.length("name").alias("len"), "name", "brand", "quantity", "unit", "category")
    return listed.groupBy(*product).agg(F.min(shortest).alias("_c"), F.count(F.lit(1)).alias("_listed"))


def merge_offers(cells: DataFrame, product: list[str]) -> DataFrame:
    """Combine :func:`best_offer` rows of finer groups into coarser ones."""
    return cells.groupBy(*product, "store", "city").agg(
        F.min("best").alias("best"),
        F.min("first_ord").alias("first_ord"),
        F.sum("rows").alias("rows"),
        F.min("canonical").alias("canonical"),
    )


def canonical_item(rows: DataFrame, product: list[str]) -> DataFrame:
    """The row with the shortest name of each cluster, first on ties."""
    shortest = F.struct(F.length("name").alias("len"), "ord", "name", "brand", "quantity", "unit", "category")
    return rows.groupBy(*product).agg(F.min(shortest).alias("c")).select(
        *product, F.col("c.name").alias("title"), "c.brand", "c.quantity", "c.unit", "c.category"
    )


def assemble_gold(offers: DataFrame, product: list[str], facts: DataFrame | None = None) -> DataFrame:
    """Nested products from their best offers, in order of first sight.

    A product has at most one offer per store and city by now, so the list
    is bounded by the number of markets.  ``facts`` of :func:`product_facts`
    stand for the facts the offers do not carry; products without are left out,
    and the rows of one listed several times count as often.
    """
    gold = offers.groupBy(*product).agg(
        F.sort_array(
            F.collect_list(
                F.struct("first_ord", "store", "city", "best.price", "best.unit_price", "best.timestamp")
            )
        ).alias("_offers"),
        F.min("best.price").alias("min_price"),
        F.max("best.price").alias("max_price"),
        F.count(F.lit(1)).alias("match_count"),
        F.sum("rows").alias("cluster_size"),
        *([F.min("canonical").alias("_c")] if facts is None else []),
    )
    if facts is not None:
        gold = gold.join(facts, product).withColumn("cluster_size", F.col("cluster_size") * F.col("_listed"))

    def offer(o: Column) -> Column:
        kept = [o[f].alias(f) for f in ("store", "city", "price", "unit_price")]
        return F.struct(*kept, o["timestamp"].cast("string").alias("timestamp"))

    return gold.select(
        *product,
        F.coalesce("_c.name", F.lit("")).alias("title"),
        F.coalesce("_c.brand", F.lit("Generic")).alias("brand"),
        F.coalesce("_c.quantity", F.lit(1.0)).alias("quantity"),
        F.coalesce("_c.unit", F.lit("unit")).alias("unit"),
        F.coalesce("_c.category", F.lit("Unknown")).alias("category"),
        F.transform("_offers", offer).alias("offers"),
        "min_price",
        "max_price",
        "match_count",
        "cluster_size",
        F.current_timestamp().cast("string").alias("processed_at"),
    )


def resolve_entities(
    listings: DataFrame,
    threshold: int = THRESHOLD,
    method: str = "token_sort",
    heads_per_file: int = FIRST_HEADS,
) -> DataFrame:
    """Gold products of cleaned listings; ``ord`` is the order of arrival."""
    rows = block_key(listings).withColumn("form", compared_form(F.col("name"), method))
    # Fold copies per market before anything is joined or compared.
    fold = [*BLOCK, "form"]
    if method == "jaccard":
        # An empty title is a product of its own, told apart by its order.
        rows = rows.withColumn("alone", F.when(F.col("form") == "", F.col("ord")))
        fold = [*fold, "alone"]
    cells = materialise(best_offer(rows, fold))
    forms = cells.select(*BLOCK, "form", F.col("first_ord").alias("ord"))
    if method == "jaccard":
        forms = forms.filter(F.col("form") != "")
    led = materialise(leader_clusters(forms, threshold, method, heads_per_file))
    led = led.select(*BLOCK, "form", "leader_form")
    cells = cells.join(led, [*BLOCK, "form"], "left").withColumn(
        "leader_form", F.coalesce("leader_form", "form")
    )
    identity = [F.col(c).cast("string") for c in BLOCK] + [F.col("leader_form")]
    if method == "jaccard":
        identity.append(F.to_json(F.struct("alone")))
    cells = cells.withColumn("product_id", product_id(*identity))
    return assemble_gold(merge_offers(cells, ["product_id"]), ["product_id"])
