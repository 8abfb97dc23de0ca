"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The fixture tables are re-derived from the driver tables with the same rules
as ``readlens.sources.fixtures``, written independently in SQL, and each query
is the plain-SQL statement of the operator's definition (window functions,
joins, HAVING) rather than a transcription of the Spark plan.
"""

from __future__ import annotations

from readlens.sources import fixtures as fx

# The driver tables' columns in their order (i int, l long, d double, s string, t timestamp, f floats).
DRIVER_COLUMNS = {
    "region": "i r_regionkey, s r_name",
    "nation": "i n_nationkey, s n_name, i n_regionkey",
    "customer": "l c_custkey, s c_name, i c_nationkey, d c_acctbal, s c_mktsegment",
    "supplier": "l s_suppkey, s s_name, i s_nationkey, d s_acctbal",
    "part": "l p_partkey, s p_name, s p_brand, s p_type, i p_size, d p_retailprice",
    "orders": "l o_orderkey, l o_custkey, s o_orderstatus, d o_totalprice, t o_orderdate, s o_orderpriority",
    "lineitem": "l l_orderkey, l l_partkey, l l_suppkey, i l_linenumber, d l_quantity, d l_extendedprice, d l_discount, d l_tax, "
                "s l_returnflag, s l_linestatus, t l_shipdate",
    "events": "l event_id, t ts, l user_id, s event_type, d value, s props",
    "documents": "l doc_id, s text, s lang, s source, l n_chars",
    "embeddings": "l vec_id, f embedding, i label",
    "pages": "l page_id, s url, s html",
    "benchmark": "l item_id, s text",
    "labels": "l doc_id, i quality, i toxic",
    "conversations": "l conv_id, l turn, s role, s text",
}
#: Between the common table expressions and the statement of a query that others build on.
MARK = "/*rows*/"
Q = fx.QUANTILE
Q_LOW = 1.0 - fx.QUANTILE
T = fx.HYBRID_THRESH
R = fx.HYBRID_RATIO
A = fx.HYBRID_KEY_A
B = fx.HYBRID_KEY_B

DATE = "strftime(l.l_shipdate, '%a %b %d %H:%M:%S +0000 %Y')"
YEAR = r"TRY_CAST(regexp_extract({c}, '(\d{{4}})$', 1) AS INTEGER)"
MONTH_TOKEN = r"regexp_extract({c}, '^[A-Za-z]{{3}}\s+([A-Za-z]{{3}})\s+\d{{1,2}}\s', 1)"
MONTH = (
    "CASE " + MONTH_TOKEN + " "
    "WHEN 'Jan' THEN 1 WHEN 'Feb' THEN 2 WHEN 'Mar' THEN 3 WHEN 'Apr' THEN 4 "
    "WHEN 'May' THEN 5 WHEN 'Jun' THEN 6 WHEN 'Jul' THEN 7 WHEN 'Aug' THEN 8 "
    "WHEN 'Sep' THEN 9 WHEN 'Oct' THEN 10 WHEN 'Nov' THEN 11 WHEN 'Dec' THEN 12 END"
)


def year(c: str) -> str:
    return YEAR.format(c=c)


def month(c: str) -> str:
    return MONTH.format(c=c)


def midx(c: str) -> str:
    return f"(({c}) // 100 * 12 + ({c}) % 100 - 1)"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


# ---------------------------------------------------------------- fixtures
INTERACTIONS = f"""
interactions AS (
  SELECT CAST(l.l_partkey AS VARCHAR) AS book_id,
         CAST(o.o_custkey AS VARCHAR) AS user_id,
         CAST(l.l_quantity AS BIGINT) % 6 AS rating,
         CASE WHEN l.l_orderkey % 97 = 0 THEN NULL
              WHEN l.l_orderkey % 89 = 0 THEN ''
              WHEN l.l_orderkey % 499 = 0 THEN left({DATE}, length({DATE}) - 4) || '0101'
              ELSE {DATE} END AS date_added
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

INTERACTIONS_CLEAN = f"""
interactions_clean AS (
  SELECT CAST(l.l_partkey AS VARCHAR) AS book_id,
         CAST(o.o_custkey AS VARCHAR) AS user_id,
         CAST(l.l_quantity AS BIGINT) % 6 AS rating,
         {DATE} AS date_added
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

BOOKS = """
books AS (
  SELECT CAST(p_partkey AS VARCHAR) AS book_id, p_name AS title,
         CASE WHEN p_partkey % 19 = 0 THEN NULL
              WHEN p_partkey % 17 = 0 THEN ''
              WHEN p_partkey % 23 = 0 THEN 'n/a'
              ELSE CAST(1955 + p_size AS VARCHAR) END AS publication_year
  FROM part)"""

# votes per (book, segment); absent segments have no row
GENRE_VOTES = """
genre_votes AS (
  SELECT CAST(l.l_partkey AS VARCHAR) AS book_id, c.c_mktsegment AS genre, count(*) AS votes
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2)"""

# one row per book that has any vote, with the two hybrid slots (0 when absent)
PAIR_VOTES = f"""
pair_votes AS (
  SELECT book_id,
         CAST(coalesce(sum(votes) FILTER (WHERE genre = '{A}'), 0) AS BIGINT) AS fantasy_votes,
         CAST(coalesce(sum(votes) FILTER (WHERE genre = '{B}'), 0) AS BIGINT) AS romance_votes
  FROM genre_votes GROUP BY book_id)"""

REVIEWS = f"""
reviews AS (
  SELECT CAST(l.l_partkey AS VARCHAR) AS book_id,
         {DATE} AS date_added,
         CASE WHEN l.l_suppkey % 11 = 0 THEN NULL ELSE CAST(l.l_quantity AS BIGINT) % 6 END AS rating,
         CASE l.l_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN NULL
              ELSE 'order ' || CAST(l.l_orderkey AS VARCHAR) END AS review_text
  FROM lineitem l)"""

SENTIMENT = """
sentiment_scores AS (
  SELECT CAST(l_partkey AS VARCHAR) AS book_id,
         CAST(l_quantity AS BIGINT) % 7 AS rating,
         round((l_discount - 0.05) * 20, 2) AS sentiment_score
  FROM lineitem)"""

# ------------------------------------------------------------- attention
MONTHLY = f"""
monthly AS (
  SELECT book_id, y * 100 + m AS yyyymm, count(*) AS n_month
  FROM (SELECT TRY_CAST(book_id AS BIGINT) AS book_id,
               {year('date_added')} AS y, {month('date_added')} AS m
        FROM interactions_clean
        WHERE date_added IS NOT NULL AND length(date_added) > 0)
  WHERE y IS NOT NULL AND m IS NOT NULL
  GROUP BY 1, 2)"""

TOTALS = f"""
totals AS (
  SELECT book_id, CAST(sum(n_month) AS BIGINT) AS total_interactions, min(yyyymm) AS first_yyyymm
  FROM monthly GROUP BY book_id HAVING sum(n_month) >= {fx.MIN_TOTAL})"""

PEAK = """
peak AS (
  SELECT book_id, yyyymm AS peak_yyyymm, n_month AS peak_interactions
  FROM (SELECT m.*, row_number() OVER (PARTITION BY book_id ORDER BY n_month DESC, yyyymm ASC) AS rn
        FROM monthly m WHERE book_id IN (SELECT book_id FROM totals))
  WHERE rn = 1)"""

FEATS = f"""
feats AS (
  SELECT t.book_id, t.total_interactions, t.first_yyyymm, p.peak_yyyymm, p.peak_interactions,
         p.peak_interactions / t.total_interactions AS peak_share,
         CAST({midx('p.peak_yyyymm')} - {midx('t.first_yyyymm')} AS INTEGER) AS time_to_peak_months
  FROM totals t JOIN peak p ON t.book_id = p.book_id)"""

THRESHOLDS = f"""
thresholds AS (
  SELECT CAST(quantile_disc(peak_share, {dbl(Q_LOW)}) AS DOUBLE) AS ps_low,
         CAST(quantile_disc(peak_share, {dbl(Q)}) AS DOUBLE) AS ps_high,
         CAST(quantile_disc(time_to_peak_months, {dbl(Q_LOW)}) AS DOUBLE) AS ttp_low,
         CAST(quantile_disc(time_to_peak_months, {dbl(Q)}) AS DOUBLE) AS ttp_high
  FROM feats HAVING count(*) > 0)"""

LABELED = """
labeled AS (
  SELECT f.*,
         CASE WHEN f.peak_share >= t.ps_high AND f.time_to_peak_months <= t.ttp_low THEN 'viral'
              WHEN f.peak_share <= t.ps_low AND f.time_to_peak_months >= t.ttp_high THEN 'traditional'
              ELSE 'other' END AS class
  FROM feats f LEFT JOIN thresholds t ON TRUE)"""

ATTENTION = [INTERACTIONS_CLEAN, MONTHLY, TOTALS, PEAK, FEATS, THRESHOLDS, LABELED]

CLEAN_SENT = """
clean_sent AS (
  SELECT * FROM (
    SELECT TRY_CAST(book_id AS BIGINT) AS book_id, TRY_CAST(rating AS INTEGER) AS rating,
           TRY_CAST(sentiment_score AS DOUBLE) AS sentiment_score
    FROM sentiment_scores)
  WHERE book_id IS NOT NULL AND rating IS NOT NULL AND sentiment_score IS NOT NULL
    AND rating BETWEEN 0 AND 5 AND rating <> 0 AND sentiment_score <> 0.0)"""

SENT_JOINED = """
sent_joined AS (
  SELECT l.class, s.rating, s.sentiment_score
  FROM clean_sent s JOIN labeled l ON s.book_id = l.book_id)"""

# ----------------------------------------------------------------- genres
MEMBERSHIP = f"""
membership AS (SELECT DISTINCT book_id, genre FROM genre_votes WHERE votes >= {T})"""

HYBRID = f"""
hybrid AS (
  SELECT DISTINCT book_id, 'romantasy' AS genre FROM pair_votes
  WHERE fantasy_votes >= {T} AND romance_votes >= {T}
    AND least(fantasy_votes, romance_votes) / greatest(fantasy_votes, romance_votes) >= {dbl(R)})"""

MEMBERSHIP_ALL = """
membership_all AS (SELECT * FROM membership UNION ALL SELECT * FROM hybrid)"""

FLAGS = f"""
flags AS (
  SELECT book_id, fantasy_votes, romance_votes,
         CAST(fantasy_votes >= {T} AND romance_votes >= {T} AS INTEGER) AS is_romantasy,
         CAST(fantasy_votes >= {T} AND romance_votes < {T} AS INTEGER) AS is_fantasy_only,
         CAST(fantasy_votes < {T} AND romance_votes >= {T} AS INTEGER) AS is_romance_only
  FROM pair_votes)"""

GENRES = [GENRE_VOTES, PAIR_VOTES, MEMBERSHIP, HYBRID, MEMBERSHIP_ALL]

PUB_YEARS = """
pub_years AS (
  SELECT book_id, pub_year FROM (
    SELECT book_id, CASE WHEN regexp_matches(publication_year, '^[0-9]+$')
                         THEN TRY_CAST(publication_year AS INTEGER) END AS pub_year
    FROM books)
  WHERE pub_year BETWEEN 1960 AND 2019)"""

SUPPLY = """
supply AS (
  SELECT g.pub_year, g.genre, g.n_books_genre, t.n_books_total,
         g.n_books_genre / t.n_books_total AS share_books_genre
  FROM (SELECT p.pub_year, m.genre, count(DISTINCT p.book_id) AS n_books_genre
        FROM pub_years p JOIN membership_all m ON p.book_id = m.book_id GROUP BY 1, 2) g
  JOIN (SELECT pub_year, count(DISTINCT book_id) AS n_books_total FROM pub_years GROUP BY 1) t
    ON g.pub_year = t.pub_year)"""

ADDED = f"""
added AS (
  SELECT book_id, added_year FROM (
    SELECT book_id, {year('date_added')} AS added_year FROM interactions
    WHERE date_added IS NOT NULL AND length(date_added) > 0)
  WHERE added_year IS NOT NULL)"""

DEMAND = """
demand AS (
  SELECT g.added_year, g.genre, g.n_interactions_genre, t.n_interactions_total,
         g.n_interactions_genre / t.n_interactions_total AS share_interactions_genre
  FROM (SELECT a.added_year, m.genre, count(*) AS n_interactions_genre
        FROM added a JOIN membership_all m ON a.book_id = m.book_id GROUP BY 1, 2) g
  JOIN (SELECT added_year, count(*) AS n_interactions_total FROM added GROUP BY 1) t
    ON g.added_year = t.added_year)"""

W_START, W_END, W_K = 1996, 1998, 50

WINDOW_ROWS = f"""
window_rows AS (
  SELECT book_id FROM interactions
  WHERE date_added IS NOT NULL AND {year('date_added')} BETWEEN {W_START} AND {W_END})"""

WINDOW_TOTALS = """
window_totals AS (
  SELECT (SELECT count(*) FROM window_rows) AS total_all,
         (SELECT count(*) FROM window_rows w JOIN (SELECT DISTINCT book_id FROM hybrid) h
            ON w.book_id = h.book_id) AS total_rom)"""

CULPRITS = f"""
culprits AS (
  SELECT c.book_id, c.n_romantasy_interactions, b.title,
         c.n_romantasy_interactions / t.total_rom AS share_within_romantasy,
         c.n_romantasy_interactions / t.total_all AS share_of_total
  FROM (SELECT w.book_id, count(*) AS n_romantasy_interactions
        FROM window_rows w JOIN (SELECT DISTINCT book_id FROM hybrid) h ON w.book_id = h.book_id
        GROUP BY 1) c
  CROSS JOIN window_totals t
  LEFT JOIN books b ON c.book_id = b.book_id
  ORDER BY share_within_romantasy DESC, n_romantasy_interactions DESC, c.book_id ASC,
           b.title ASC NULLS FIRST
  LIMIT {W_K})"""


def _report_of(table: str, columns: str) -> str:
    """A row of the dataset report: what DuckDB's own catalogue says of the table, and its first five rows as JSON."""
    fields = [c.split() for c in columns.split(", ")]
    cell = {"t": "strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')", "f": "len({c})"}
    pack = ", ".join(f"{c} := " + cell.get(k, "{c}").format(c=c) for k, c in fields)
    kinds = {"INTEGER": "integer", "BIGINT": "long", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}
    kind = "CASE column_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items()) + " ELSE 'array' END"
    element = "CASE WHEN column_type = 'FLOAT[]' THEN ' |    |-- element: float (containsNull = true)' || chr(10) ELSE '' END"
    return f"""
        SELECT '{table}' AS name, 'parquet' AS format, 'ok' AS status, count(*) AS n_columns,
               string_agg(column_name, ',' ORDER BY column_name) AS column_names,
               'root' || chr(10) || string_agg(' |-- ' || column_name || ': ' || {kind} || ' (nullable = true)' || chr(10) || {element}, '' ORDER BY k) AS schema,
               (SELECT '[' || string_agg(j, ',' ORDER BY k) || ']'
                FROM (SELECT row_number() OVER () AS k, CAST(to_json(struct_pack({pack})) AS VARCHAR) AS j FROM (SELECT * FROM {table} LIMIT 5))) AS sample
        FROM (SELECT row_number() OVER () AS k, * FROM (DESCRIBE {table}))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


TOP_COLS = ("f.book_id, b.title, f.total_interactions, f.peak_yyyymm, f.peak_interactions, "
            "f.peak_share, f.time_to_peak_months")
BOOK_TITLES = "(SELECT TRY_CAST(book_id AS BIGINT) AS book_id, title FROM books)"


def sql() -> dict[str, str]:
    attention_ctes = with_(*ATTENTION)
    genre_base = [INTERACTIONS, BOOKS] + GENRES
    out = {
        "interactions_per_year": with_(INTERACTIONS) + f"""
            SELECT year, count(*) AS n_interactions FROM (
              SELECT {year('date_added')} AS year FROM interactions
              WHERE date_added IS NOT NULL AND length(date_added) > 0)
            WHERE year BETWEEN 1900 AND 2026 GROUP BY year ORDER BY year""",
        "publications_per_year": with_(BOOKS) + """
            SELECT year, count(*) AS n_published_books FROM (
              SELECT TRY_CAST(publication_year AS INTEGER) AS year FROM books
              WHERE regexp_matches(publication_year, '^[0-9]{4}$'))
            WHERE year BETWEEN 1900 AND 2026 GROUP BY year ORDER BY year""",
        "reviews_per_year": with_(REVIEWS) + f"""
            SELECT year, count(*) AS n_reviews_total,
                   count(*) FILTER (WHERE rating IS NOT NULL AND NOT has_text) AS n_reviews_rating_only,
                   count(*) FILTER (WHERE has_text) AS n_reviews_with_text
            FROM (SELECT {year('date_added')} AS year, rating,
                         coalesce(review_text IS NOT NULL AND length(trim(review_text)) > 0, FALSE) AS has_text
                  FROM reviews WHERE date_added IS NOT NULL AND length(date_added) > 0)
            WHERE year BETWEEN 1900 AND 2026 GROUP BY year ORDER BY year""",
        "monthly_counts": with_(INTERACTIONS, MONTHLY.replace("interactions_clean", "interactions"))
        + "SELECT book_id, yyyymm, n_month FROM monthly",
        "entity_totals": with_(INTERACTIONS_CLEAN, MONTHLY, TOTALS) + "SELECT * FROM totals",
        "peak_month": with_(INTERACTIONS_CLEAN, MONTHLY, TOTALS, PEAK) + "SELECT * FROM peak",
        "attention_features": with_(INTERACTIONS_CLEAN, MONTHLY, TOTALS, PEAK, FEATS) + "SELECT * FROM feats",
        "quantile_thresholds": with_(INTERACTIONS_CLEAN, MONTHLY, TOTALS, PEAK, FEATS, THRESHOLDS)
        + "SELECT * FROM thresholds",
        "classify_attention": attention_ctes + "SELECT * FROM labeled",
        "class_counts": attention_ctes + 'SELECT class, count(*) AS "count" FROM labeled GROUP BY class ORDER BY class',
        "top_viral": with_(*ATTENTION, BOOKS) + f"""
            SELECT {TOP_COLS} FROM labeled f LEFT JOIN {BOOK_TITLES} b ON f.book_id = b.book_id
            WHERE f.class = 'viral'
            ORDER BY f.peak_share DESC, f.time_to_peak_months ASC, f.total_interactions DESC,
                     f.book_id ASC, b.title ASC NULLS FIRST
            LIMIT 10""",
        "top_traditional": with_(*ATTENTION, BOOKS) + f"""
            SELECT {TOP_COLS} FROM labeled f LEFT JOIN {BOOK_TITLES} b ON f.book_id = b.book_id
            WHERE f.class = 'traditional'
            ORDER BY f.peak_share ASC, f.time_to_peak_months DESC, f.total_interactions DESC,
                     f.book_id ASC, b.title ASC NULLS FIRST
            LIMIT 10""",
        "rating_decay": with_(*ATTENTION, REVIEWS) + MARK + f"""
            SELECT class, months_since_peak, count(*) AS n_ratings, avg(rating) AS avg_rating
            FROM (SELECT l.class, r.rating,
                         CAST({midx('r.y * 100 + r.m')} - {midx('l.peak_yyyymm')} AS INTEGER) AS months_since_peak
                  FROM (SELECT TRY_CAST(book_id AS BIGINT) AS book_id, CAST(rating AS DOUBLE) AS rating,
                               {year('date_added')} AS y, {month('date_added')} AS m
                        FROM reviews WHERE rating IS NOT NULL) r
                  JOIN labeled l ON r.book_id = l.book_id
                  WHERE r.y IS NOT NULL AND r.m IS NOT NULL)
            WHERE months_since_peak BETWEEN -6 AND 36
            GROUP BY class, months_since_peak ORDER BY class, months_since_peak""",
        "clean_sentiment": with_(SENTIMENT, CLEAN_SENT) + "SELECT * FROM clean_sent",
        "sentiment_by_class_rating": with_(*ATTENTION, SENTIMENT, CLEAN_SENT, SENT_JOINED) + """
            SELECT class, rating, count(*) AS n, avg(sentiment_score) AS avg_sentiment,
                   quantile_disc(sentiment_score, 0.05::DOUBLE) AS p05_sentiment,
                   quantile_disc(sentiment_score, 0.95::DOUBLE) AS p95_sentiment
            FROM sent_joined GROUP BY class, rating ORDER BY class, rating""",
        "corr_by_class": with_(*ATTENTION, SENTIMENT, CLEAN_SENT, SENT_JOINED) + """
            SELECT class, count(*) AS n,
                   covar_pop(rating, sentiment_score)
                     / nullif(stddev_pop(rating) * stddev_pop(sentiment_score), 0) AS pearson_corr
            FROM sent_joined GROUP BY class ORDER BY class""",
        "genre_votes": with_(GENRE_VOTES) + "SELECT book_id, genre, votes FROM genre_votes",
        "genre_membership": with_(GENRE_VOTES, MEMBERSHIP) + "SELECT * FROM membership",
        "hybrid_membership": with_(GENRE_VOTES, PAIR_VOTES, HYBRID) + "SELECT * FROM hybrid",
        "hybrid_flags": with_(GENRE_VOTES, PAIR_VOTES, FLAGS) + "SELECT * FROM flags",
        "membership_with_hybrid": with_(*GENRES) + "SELECT * FROM membership_all",
        "supply_share": with_(*genre_base, PUB_YEARS, SUPPLY) + "SELECT * FROM supply ORDER BY pub_year, genre",
        "demand_share": with_(*genre_base, ADDED, DEMAND) + "SELECT * FROM demand ORDER BY added_year, genre",
        "latest_year_slice": with_(*genre_base, ADDED, DEMAND) + """
            SELECT * FROM demand
            WHERE added_year = (SELECT max(added_year) FROM demand) AND genre = 'romantasy'""",
        "hybrid_publication_trend": with_(BOOKS, GENRE_VOTES, PAIR_VOTES, FLAGS, PUB_YEARS) + """
            SELECT pub_year, count(DISTINCT p.book_id) AS n_books,
                   CAST(sum(is_romantasy) AS BIGINT) AS n_romantasy,
                   CAST(sum(is_fantasy_only) AS BIGINT) AS n_fantasy_only,
                   CAST(sum(is_romance_only) AS BIGINT) AS n_romance_only,
                   sum(is_romantasy) / count(DISTINCT p.book_id) AS share_romantasy
            FROM pub_years p JOIN flags f ON p.book_id = f.book_id
            GROUP BY pub_year ORDER BY pub_year""",
        "hybrid_adoption_trend": with_(INTERACTIONS, GENRE_VOTES, PAIR_VOTES, FLAGS, ADDED) + """
            SELECT added_year, count(*) AS n_interactions,
                   CAST(sum(is_romantasy) AS BIGINT) AS n_romantasy_interactions,
                   sum(is_romantasy) / count(*) AS share_romantasy_interactions
            FROM added a JOIN flags f ON a.book_id = f.book_id
            GROUP BY added_year ORDER BY added_year""",
        "window_totals": with_(INTERACTIONS, *GENRES, WINDOW_ROWS, WINDOW_TOTALS) + "SELECT * FROM window_totals",
        "spike_culprits": with_(*genre_base, WINDOW_ROWS, WINDOW_TOTALS, CULPRITS) + "SELECT * FROM culprits",
    }
    # ---- series operators over the result tables
    demand_q = with_(*genre_base, ADDED, DEMAND)
    top3 = """
        top3 AS (SELECT genre, avg(share_interactions_genre) AS mean_share FROM demand
                 WHERE added_year BETWEEN 1996 AND 2000 AND share_interactions_genre IS NOT NULL
                 GROUP BY genre ORDER BY mean_share DESC, genre DESC LIMIT 3)"""
    out["top_k_by_mean_share"] = demand_q.rstrip() + "," + top3 + " SELECT * FROM top3"
    out["with_highlight"] = (
        demand_q.rstrip() + "," + top3 + " SELECT genre FROM top3 UNION SELECT 'romantasy' AS genre"
    )
    out["align_series_null"] = with_(*genre_base, PUB_YEARS, SUPPLY) + """,
        top3 AS (SELECT genre FROM supply WHERE pub_year BETWEEN 1960 AND 2019
                 GROUP BY genre ORDER BY avg(share_books_genre) DESC, genre DESC LIMIT 3),
        keep AS (SELECT genre FROM top3 UNION SELECT 'romantasy'),
        cropped AS (SELECT s.* FROM supply s WHERE pub_year BETWEEN 1960 AND 2005
                    AND genre IN (SELECT genre FROM keep)),
        axis AS (SELECT DISTINCT pub_year FROM cropped)
        SELECT k.genre, a.pub_year, c.share_books_genre
        FROM keep k CROSS JOIN axis a
        LEFT JOIN cropped c ON c.genre = k.genre AND c.pub_year = a.pub_year
        ORDER BY k.genre, a.pub_year"""
    out["align_series_zero"] = with_(REVIEWS) + f"""
        SELECT year, coalesce(CAST(n_reviews_total AS DOUBLE), 0.0) AS n_reviews_total,
               coalesce(CAST(n_reviews_rating_only AS DOUBLE), 0.0) AS n_reviews_rating_only,
               coalesce(CAST(n_reviews_with_text AS DOUBLE), 0.0) AS n_reviews_with_text
        FROM (SELECT year, count(*) AS n_reviews_total,
                     count(*) FILTER (WHERE rating IS NOT NULL AND NOT has_text) AS n_reviews_rating_only,
                     count(*) FILTER (WHERE has_text) AS n_reviews_with_text
              FROM (SELECT {year('date_added')} AS year, rating,
                           coalesce(review_text IS NOT NULL AND length(trim(review_text)) > 0, FALSE) AS has_text
                    FROM reviews WHERE date_added IS NOT NULL AND length(date_added) > 0)
              WHERE year BETWEEN 1900 AND 2026 GROUP BY year)
        WHERE year BETWEEN 1990 AND 2017 ORDER BY year"""
    out["crop_years"] = with_(INTERACTIONS, GENRE_VOTES, PAIR_VOTES, FLAGS, ADDED) + """
        SELECT * FROM (
          SELECT added_year, count(*) AS n_interactions,
                 CAST(sum(is_romantasy) AS BIGINT) AS n_romantasy_interactions,
                 sum(is_romantasy) / count(*) AS share_romantasy_interactions
          FROM added a JOIN flags f ON a.book_id = f.book_id GROUP BY added_year)
        WHERE added_year BETWEEN 1996 AND 2000 ORDER BY added_year"""
    out["scale_units"] = with_(INTERACTIONS) + f"""
        SELECT year, n_interactions, CAST(n_interactions AS DOUBLE) / 1000 AS n_interactions_k,
               CAST(n_interactions AS DOUBLE) / 1000000 AS n_interactions_m
        FROM (SELECT year, count(*) AS n_interactions FROM (
                SELECT {year('date_added')} AS year FROM interactions
                WHERE date_added IS NOT NULL AND length(date_added) > 0)
              WHERE year BETWEEN 1900 AND 2026 GROUP BY year)"""
    out["error_bars"] = with_(*ATTENTION, SENTIMENT, CLEAN_SENT, SENT_JOINED) + """
        SELECT *, avg_sentiment - p05_sentiment AS err_low, p95_sentiment - avg_sentiment AS err_high
        FROM (SELECT class, rating, count(*) AS n, avg(sentiment_score) AS avg_sentiment,
                     quantile_disc(sentiment_score, 0.05::DOUBLE) AS p05_sentiment,
                     quantile_disc(sentiment_score, 0.95::DOUBLE) AS p95_sentiment
              FROM sent_joined GROUP BY class, rating)"""
    out["min_support"] = out["rating_decay"].replace(
        "GROUP BY class, months_since_peak ORDER BY class, months_since_peak",
        "GROUP BY class, months_since_peak HAVING count(*) >= 5 "
        "AND class IN ('viral', 'traditional') AND months_since_peak BETWEEN -6 AND 24",
    )
    out["read_result_csv"] = out["interactions_per_year"]
    out["read_table_json"] = out["publications_per_year"]
    cut = "p_partkey % 50 = 0"
    out["json_damaged_lines"] = with_(BOOKS) + f"""
        SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM part WHERE {cut}) AS n_lines,
               (SELECT count(*) FROM part WHERE {cut}) AS n_damaged, (SELECT count(*) FROM part) AS n_books,
               CAST((SELECT sum(length('{{"book_id":"' || book_id || '","title":"' || title || '"'
                                || coalesce(',"publication_year":"' || publication_year || '"', '') || '}}') - 2)
                     FROM books WHERE CAST(book_id AS BIGINT) % 50 = 0) AS BIGINT) AS damaged_chars"""
    out["csv_sink_ordered"] = with_(INTERACTIONS_CLEAN, MONTHLY) + "SELECT book_id, yyyymm, n_month, TRUE AS in_order FROM monthly"
    out["preview_last_years"] = out["interactions_per_year"].replace("ORDER BY year", "ORDER BY year DESC LIMIT 3")
    out["sentiment_by_class_rating_sketch"] = out["sentiment_by_class_rating"]  # exact for groups of under 10,000 rows
    out["all_membership"] = out["membership_with_hybrid"]
    for key, rank in (("top_months", "row_number() OVER (PARTITION BY book_id ORDER BY n_month DESC, yyyymm ASC)"),
                      ("top_months_with_ties", "rank() OVER (PARTITION BY book_id ORDER BY n_month DESC)")):
        out[key] = with_(INTERACTIONS_CLEAN, MONTHLY) + f"""
            SELECT book_id, yyyymm, n_month, CAST(k AS INTEGER) AS rank FROM (SELECT m.*, {rank} AS k FROM monthly m) WHERE k <= 3"""
    out["quantile_sketch"] = with_(INTERACTIONS_CLEAN, MONTHLY, TOTALS, PEAK, FEATS) + """
        SELECT t AS threshold, (SELECT count(*) FROM feats) AS n, TRUE AS within
        FROM (VALUES ('ps_low'), ('ps_high'), ('ttp_low'), ('ttp_high')) x(t)"""
    named = "CASE genre " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fx.MAP_KEYS.items()) + " END"
    huge = f"CASE WHEN CAST(book_id AS BIGINT) % {fx.HUGE_EVERY} = 0 THEN {fx.HUGE_FACTOR} ELSE 1 END"
    named_votes = f"SELECT book_id, {named} AS genre, CAST(votes * {huge} AS BIGINT) AS votes FROM genre_votes"
    out["named_votes"] = out["map_votes"] = with_(GENRE_VOTES) + named_votes
    out["map_votes_lookup"] = with_(
        GENRE_VOTES, f"genre_votes_named AS ({named_votes})",
        PAIR_VOTES.replace("FROM genre_votes", "FROM genre_votes_named").replace(f"'{A}'", "'fantasy, paranormal'").replace(f"'{B}'", "'romance'"),
        FLAGS) + "SELECT * FROM flags"
    out["align_months_by_class"] = with_(
        *ATTENTION, REVIEWS, "decay AS (" + out["rating_decay"].split(MARK)[1].replace(
            "GROUP BY class, months_since_peak ORDER BY class, months_since_peak",
            "GROUP BY class, months_since_peak HAVING count(*) >= 5") + ")") + """
        SELECT k.class, a.months_since_peak, d.avg_rating
        FROM (VALUES ('viral'), ('traditional')) k(class)
        CROSS JOIN (SELECT DISTINCT months_since_peak FROM decay
                    WHERE class IN ('viral', 'traditional') AND months_since_peak BETWEEN -6 AND 24) a
        LEFT JOIN decay d ON d.class = k.class AND d.months_since_peak = a.months_since_peak"""
    out["dataset_report"] = " UNION ALL ".join(_report_of(t, columns) for t, columns in DRIVER_COLUMNS.items())
    return {k: v.replace(MARK, "") for k, v in out.items()}
