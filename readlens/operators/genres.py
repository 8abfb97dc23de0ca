"""Genre membership, a synthetic two-genre hybrid, and genre shares in what is
published (supply) and in what is read (demand) — Q17-Q28.

Scale notes
* Genre votes are nested per entity; turning them into rows is a Generate
  inside the scan stage (no shuffle) and keeps the vote type ``bigint``.
* Demand is the big one: interactions x genres-per-entity.  Interactions are
  folded first to (entity, year) -> rows with map-side combining, so the
  fan-out join sees at most one row per entity and year; a hot entity cannot
  skew it, and the join input is far smaller than the raw rows.
* Year totals have at most 10,000 rows (a year is four digits), a proven size
  bound, so they are broadcast into the share joins.
* Window totals (Q27) come back as one scalar subquery (a single struct).
* One pass over interactions per query: where the per-(entity, year) counts
  feed two branches (genre counts and year totals), nothing is inferred onto
  one branch only (NULL ids are dropped on the small side of a null-safe id
  join; the year is non-nullable once its NULL group is gone), so both
  branches keep the same plan and share the scan and its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readlens.functions.expr import non_empty, safe_int, share, trailing_year

# ---------------------------------------------------------------------------
# Fixed values of the source catalogue: vote keys and the hybrid's label.
# ---------------------------------------------------------------------------
FANTASY_KEY = "fantasy, paranormal"
ROMANCE_KEY = "romance"
HYBRID_LABEL = "romantasy"
PUB_YEAR_MIN = 1960
PUB_YEAR_MAX = 2019


def _vote(df: DataFrame, struct_col: str, key: str) -> Column:
    """Vote count for ``key`` as bigint; NULL when the key is absent."""
    dtype = df.schema[struct_col].dataType
    if isinstance(dtype, T.StructType):
        if key not in dtype.fieldNames():
            return F.lit(None).cast("long")
        return F.col(struct_col).getField(key).cast("long")
    if isinstance(dtype, T.MapType):
        return F.col(struct_col).getItem(key).cast("long")
    raise TypeError(f"{struct_col} must be a struct or a map, got {dtype.simpleString()}")


def votes_as_map(genres: DataFrame, struct_col: str = "genres") -> DataFrame:
    """``genres`` with the struct of votes as ``map<string, bigint>``, by way of JSON: keys are the field names as they are
    (commas and spaces too), absent votes have no entry, and counts above the int range stay whole.  A map column
    is returned as it is, with bigint values."""
    dtype = genres.schema[struct_col].dataType
    if isinstance(dtype, T.MapType):
        return genres.withColumn(struct_col, F.col(struct_col).cast("map<string,bigint>"))
    if not isinstance(dtype, T.StructType):
        raise TypeError(f"{struct_col} must be a struct or a map, got {dtype.simpleString()}")
    return genres.withColumn(struct_col, F.from_json(F.to_json(struct_col), F.lit("map<string,bigint>")))


def vote_of(genres: DataFrame, key: str, default: int = 0, struct_col: str = "genres") -> Column:
    """Votes for ``key`` as bigint, ``default`` where a row has none (or no votes at all)."""
    return F.coalesce(_vote(genres, struct_col, key), F.lit(default).cast("long"))


def genre_votes(genres: DataFrame, id_col: str = "book_id", struct_col: str = "genres") -> DataFrame:
    """book_id, genre, votes — one row per present (non-NULL) vote count."""
    dtype = genres.schema[struct_col].dataType
    if isinstance(dtype, T.MapType):
        rows = genres.select(id_col, F.explode(struct_col).alias("genre", "votes"))
        return rows.select(id_col, "genre", F.col("votes").cast("long").alias("votes")).where(
            F.col("votes").isNotNull()
        )
    if not isinstance(dtype, T.StructType):
        raise TypeError(f"{struct_col} must be a struct or a map, got {dtype.simpleString()}")
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("genre"), _vote(genres, struct_col, name).alias("votes"))
            for name in dtype.fieldNames()
        ]
    )
    return (
        genres.select(id_col, F.inline(pairs))
        .where(F.col("votes").isNotNull())
    )


def genre_membership(votes: DataFrame, thresh: int = 10, id_col: str = "book_id") -> DataFrame:
    """book_id, genre — distinct pairs with at least ``thresh`` votes."""
    return votes.where(F.col("votes") >= thresh).select(id_col, "genre").distinct()


def _pair_votes(genres: DataFrame, key_a: str, key_b: str, struct_col: str) -> tuple[Column, Column]:
    return vote_of(genres, key_a, struct_col=struct_col), vote_of(genres, key_b, struct_col=struct_col)


def hybrid_membership(
    genres: DataFrame,
    key_a: str = FANTASY_KEY,
    key_b: str = ROMANCE_KEY,
    thresh: int = 10,
    ratio: float = 0.2,
    label: str = HYBRID_LABEL,
    id_col: str = "book_id",
    struct_col: str = "genres",
) -> DataFrame:
    """book_id, genre=label — strict hybrid: both genres at ``thresh`` votes or more and
    min/max of the two vote counts at least ``ratio``."""
    a, b = _pair_votes(genres, key_a, key_b, struct_col)
    balanced = F.try_divide(F.least(a, b), F.greatest(a, b)) >= F.lit(float(ratio))
    return (
        genres.where((a >= thresh) & (b >= thresh) & balanced)
        .select(id_col)
        .distinct()
        .withColumn("genre", F.lit(label))
    )


def hybrid_ids(
    genres: DataFrame,
    key_a: str = FANTASY_KEY,
    key_b: str = ROMANCE_KEY,
    thresh: int = 10,
    ratio: float = 0.2,
    id_col: str = "book_id",
    struct_col: str = "genres",
) -> DataFrame:
    """Distinct ids of the strict hybrid set."""
    return hybrid_membership(genres, key_a, key_b, thresh, ratio, HYBRID_LABEL, id_col, struct_col).select(id_col)


def hybrid_flags(
    genres: DataFrame,
    key_a: str = FANTASY_KEY,
    key_b: str = ROMANCE_KEY,
    thresh: int = 10,
    a_name: str = "fantasy",
    b_name: str = "romance",
    label: str = HYBRID_LABEL,
    id_col: str = "book_id",
    struct_col: str = "genres",
) -> DataFrame:
    """Loose hybrid, per genre row: book_id, fantasy_votes, romance_votes (absent = 0),
    is_romantasy (both >= thresh), is_fantasy_only, is_romance_only as 0/1 ints.
    Column names follow ``a_name``, ``b_name`` and ``label``."""
    a, b = _pair_votes(genres, key_a, key_b, struct_col)
    av, bv = F.col(f"{a_name}_votes"), F.col(f"{b_name}_votes")
    return genres.select(id_col, a.alias(f"{a_name}_votes"), b.alias(f"{b_name}_votes")).select(
        id_col,
        f"{a_name}_votes",
        f"{b_name}_votes",
        ((av >= thresh) & (bv >= thresh)).cast("int").alias(f"is_{label}"),
        ((av >= thresh) & (bv < thresh)).cast("int").alias(f"is_{a_name}_only"),
        ((av < thresh) & (bv >= thresh)).cast("int").alias(f"is_{b_name}_only"),
    )


def membership_with_hybrid(book_genre: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Ordinary genres plus the hybrid as one more genre (bag union)."""
    return book_genre.unionByName(hybrid)


def all_membership(
    genres: DataFrame,
    key_a: str = FANTASY_KEY,
    key_b: str = ROMANCE_KEY,
    thresh: int = 10,
    ratio: float = 0.2,
    label: str = HYBRID_LABEL,
    id_col: str = "book_id",
    struct_col: str = "genres",
) -> DataFrame:
    """The rows of ``membership_with_hybrid`` over ``genre_membership`` and ``hybrid_membership``, from one pass over
    ``genres``: each row lists its genres, the hybrid with them, and is exploded once."""
    dtype = genres.schema[struct_col].dataType
    if isinstance(dtype, T.MapType):
        pairs = F.transform(F.map_entries(struct_col), lambda e: F.struct(
            e["key"].alias("genre"), e["value"].cast("long").alias("votes")))
    else:
        pairs = F.array(*[
            F.struct(F.lit(name).alias("genre"), _vote(genres, struct_col, name).alias("votes"))
            for name in dtype.fieldNames()
        ])
    enough = F.transform(F.filter(pairs, lambda p: p["votes"] >= thresh), lambda p: F.struct(
        p["genre"].alias("genre"), F.lit(False).alias("_hybrid")))
    a, b = _pair_votes(genres, key_a, key_b, struct_col)
    balanced = F.try_divide(F.least(a, b), F.greatest(a, b)) >= F.lit(float(ratio))
    hybrid = F.array(F.struct(F.lit(label).alias("genre"), F.lit(True).alias("_hybrid")))
    listed = F.when((a >= thresh) & (b >= thresh) & balanced, F.concat(enough, hybrid)).otherwise(enough)
    return genres.select(id_col, F.inline(listed)).distinct().select(id_col, "genre")


def published_years(
    books: DataFrame,
    ymin: int = PUB_YEAR_MIN,
    ymax: int = PUB_YEAR_MAX,
    id_col: str = "book_id",
    year_col: str = "publication_year",
) -> DataFrame:
    """book_id, pub_year for digits-only years in [ymin, ymax]."""
    return books.select(id_col, safe_int(year_col).alias("pub_year")).where(
        F.col("pub_year").between(ymin, ymax)
    )


def supply_share(
    books: DataFrame,
    membership: DataFrame,
    ymin: int = PUB_YEAR_MIN,
    ymax: int = PUB_YEAR_MAX,
    id_col: str = "book_id",
    year_col: str = "publication_year",
) -> DataFrame:
    """pub_year, genre, n_books_genre, n_books_total, share_books_genre.

    The denominator is every distinct book with a valid year, genre or not."""
    # distinct (book, year) pairs once, shared by both branches
    by = published_years(books, ymin, ymax, id_col, year_col).distinct()
    total = by.groupBy("pub_year").agg(F.count(id_col).alias("n_books_total"))
    counts = (
        _join_on_id(by, membership.select(id_col, "genre").distinct(), id_col)
        .groupBy("pub_year", "genre")
        .agg(F.count(id_col).alias("n_books_genre"))
    )
    return (
        _join_year_totals(counts, total, "pub_year")
        .withColumn("share_books_genre", share("n_books_genre", "n_books_total"))
        .orderBy("pub_year", "genre")
    )


def _join_on_id(big: DataFrame, small: DataFrame, id_col: str) -> DataFrame:
    """Inner join on the id that leaves ``big``'s plan untouched.

    A plain inner join makes the optimizer infer ``id IS NOT NULL`` on both
    inputs and push it into ``big``.  When ``big`` also feeds another branch of
    the same query (the year totals), the two copies then differ, exchange
    reuse fails and the interaction scan and its shuffle run twice.  Dropping
    NULL ids on the small side and joining null-safe gives the same rows (a
    NULL id matches nothing) and keeps one shared copy of ``big``."""
    s = small.where(F.col(id_col).isNotNull()).withColumnRenamed(id_col, "_sid")
    return big.join(s, big[id_col].eqNullSafe(s["_sid"]), "inner").drop("_sid")


def _join_year_totals(counts: DataFrame, totals: DataFrame, year: str) -> DataFrame:
    """Attach the per-year totals (at most 10^4 rows: broadcast).

    Both sides are already free of NULL years.  A nullable year is matched
    null-safe, which keeps the optimizer from inferring ``year IS NOT NULL``
    and pushing it down to the scan (a second parse of the text).  A year that
    is non-nullable in the schema needs no such care: the plain equi-join also
    lets a later year filter reach both sides, so they keep sharing one pass."""
    t = F.broadcast(totals.withColumnRenamed(year, "_ty"))
    if not counts.schema[year].nullable:
        return counts.join(t, counts[year] == t["_ty"], "inner").drop("_ty")
    return counts.join(t, counts[year].eqNullSafe(t["_ty"]), "inner").drop("_ty")


def added_years(
    interactions: DataFrame, id_col: str = "book_id", date_col: str = "date_added"
) -> DataFrame:
    """book_id, added_year, n — rows per (entity, trailing year of a non-empty date).

    No year bounds: junk years such as 101 stay, as in the original demand job."""
    return (
        interactions.where(non_empty(date_col))
        .select(id_col, trailing_year(date_col).alias("added_year"))
        .groupBy(id_col, "added_year")
        .agg(F.count("added_year").alias("n"))
        .where(F.col("n") > 0)
        # The NULL-year group is gone; saying so in the schema (non-nullable)
        # stops the optimizer from inferring "added_year IS NOT NULL" for joins
        # on the year and pushing it down to re-parse the text at the scan.
        .select(id_col, F.coalesce(F.col("added_year"), F.lit(0)).alias("added_year"), "n")
    )


def demand_share(
    interactions: DataFrame,
    membership: DataFrame,
    id_col: str = "book_id",
    date_col: str = "date_added",
) -> DataFrame:
    """added_year, genre, n_interactions_genre, n_interactions_total,
    share_interactions_genre.  A row counts once for every genre of its entity."""
    per = added_years(interactions, id_col, date_col)
    total = per.groupBy("added_year").agg(F.sum("n").alias("n_interactions_total"))
    counts = (
        _join_on_id(per, membership.select(id_col, "genre"), id_col)
        .groupBy("added_year", "genre")
        .agg(F.sum("n").alias("n_interactions_genre"))
    )
    return (
        _join_year_totals(counts, total, "added_year")
        .withColumn("share_interactions_genre", share("n_interactions_genre", "n_interactions_total"))
        .orderBy("added_year", "genre")
    )


def latest_year_slice(demand: DataFrame, genre: str = HYBRID_LABEL, year_col: str = "added_year") -> DataFrame:
    """Rows of ``genre`` in the latest year present in ``demand``.

    The latest year is a one-row aggregate (broadcast: one row) matched
    null-safe, so nothing is inferred onto ``demand``'s plan and both uses
    share one pass over the interactions."""
    latest = F.broadcast(demand.agg(F.max(year_col).alias("_latest")))
    return (
        demand.where(F.col("genre") == genre)
        .join(latest, F.col(year_col).eqNullSafe(F.col("_latest")), "inner")
        .drop("_latest")
    )


def hybrid_publication_trend(
    books: DataFrame,
    flags: DataFrame,
    ymin: int = PUB_YEAR_MIN,
    ymax: int = PUB_YEAR_MAX,
    label: str = HYBRID_LABEL,
    a_name: str = "fantasy",
    b_name: str = "romance",
    id_col: str = "book_id",
    year_col: str = "publication_year",
) -> DataFrame:
    """pub_year, n_books, n_romantasy, n_fantasy_only, n_romance_only, share_romantasy.

    Only books with a genre row count (inner join), unlike ``supply_share``.
    ``n_books`` is distinct, the flag counts are sums over joined rows."""
    by = published_years(books, ymin, ymax, id_col, year_col)
    j = by.join(
        flags.select(id_col, f"is_{label}", f"is_{a_name}_only", f"is_{b_name}_only"), on=id_col, how="inner"
    )
    return (
        j.groupBy("pub_year")
        .agg(
            F.count_distinct(id_col).alias("n_books"),
            F.sum(f"is_{label}").alias(f"n_{label}"),
            F.sum(f"is_{a_name}_only").alias(f"n_{a_name}_only"),
            F.sum(f"is_{b_name}_only").alias(f"n_{b_name}_only"),
        )
        .withColumn(f"share_{label}", share(f"n_{label}", "n_books"))
        .orderBy("pub_year")
    )


def hybrid_adoption_trend(
    interactions: DataFrame,
    flags: DataFrame,
    label: str = HYBRID_LABEL,
    id_col: str = "book_id",
    date_col: str = "date_added",
) -> DataFrame:
    """added_year, n_interactions, n_romantasy_interactions, share_romantasy_interactions
    over interactions whose entity has a genre row (inner join)."""
    per = added_years(interactions, id_col, date_col)
    j = per.join(flags.select(id_col, f"is_{label}"), on=id_col, how="inner")
    return (
        j.groupBy("added_year")
        .agg(
            F.sum("n").alias("n_interactions"),
            F.sum(F.col("n") * F.col(f"is_{label}")).alias(f"n_{label}_interactions"),
        )
        .withColumn(
            f"share_{label}_interactions", share(f"n_{label}_interactions", "n_interactions")
        )
        .orderBy("added_year")
    )


def _window_counts(
    interactions: DataFrame, start: int, end: int, id_col: str, date_col: str
) -> DataFrame:
    # Only a NULL check on the date here (no length check), as in the spike job.
    return (
        interactions.where(F.col(date_col).isNotNull())
        .select(id_col, trailing_year(date_col).between(start, end).alias("_in"))
        .groupBy(id_col)
        .agg(F.count_if("_in").alias("n"))
        .where(F.col("n") > 0)
    )


def window_totals(
    interactions: DataFrame,
    hybrid: DataFrame,
    start: int = 2001,
    end: int = 2004,
    id_col: str = "book_id",
    date_col: str = "date_added",
) -> DataFrame:
    """total_all, total_rom: rows in the year window, and those of hybrid entities.
    One pass; hybrid ids are de-duplicated before the lookup."""
    per = _window_counts(interactions, start, end, id_col, date_col)
    ids = hybrid.select(id_col).distinct().withColumn("_hit", F.lit(1))
    return per.join(ids, on=id_col, how="left").agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total_all"),
        F.coalesce(F.sum(F.col("n") * F.coalesce(F.col("_hit"), F.lit(0))), F.lit(0).cast("long")).alias("total_rom"),
    )


def spike_culprits(
    interactions: DataFrame,
    hybrid: DataFrame,
    books: DataFrame,
    start: int = 2001,
    end: int = 2004,
    k: int = 50,
    label: str = HYBRID_LABEL,
    id_col: str = "book_id",
    date_col: str = "date_added",
) -> DataFrame:
    """book_id, n_romantasy_interactions, title, share_within_romantasy, share_of_total:
    the k hybrid entities with most rows in the window (ties: id ascending)."""
    per = _window_counts(interactions, start, end, id_col, date_col)
    ids = hybrid.select(id_col).distinct()
    counts = _join_on_id(per, ids, id_col).select(
        id_col, F.col("n").alias(f"n_{label}_interactions")
    )
    tot = window_totals(interactions, hybrid, start, end, id_col, date_col).select(
        F.struct("total_all", "total_rom").alias("t")
    ).scalar()
    n = F.col(f"n_{label}_interactions")
    scored = counts.withColumn(f"share_within_{label}", F.try_divide(n, tot["total_rom"])).withColumn(
        "share_of_total", F.try_divide(n, tot["total_all"])
    )
    order = [F.col(f"share_within_{label}").desc(), n.desc(), F.col(id_col).asc()]
    picked = scored.orderBy(*order).limit(k)
    # titles: semi-reduce the catalogue with the k broadcast ids, then left join
    cat = books.select(id_col, "title").join(F.broadcast(picked.select(id_col)), on=id_col, how="left_semi")
    return (
        picked.join(cat, on=id_col, how="left")
        .orderBy(*order, F.col("title").asc_nulls_first())
        .limit(k)
        .select(id_col, f"n_{label}_interactions", "title", f"share_within_{label}", "share_of_total")
    )
