"""DuckDB re-derivation of the domain tables (same rules as ``reelsift.adapt``)."""

RATINGS = """ratings AS (
  SELECT CAST(o.o_custkey AS INTEGER) AS userId, CAST(l.l_partkey AS INTEGER) AS movieId,
         CAST(ceil(l.l_quantity / 5) / 2 AS FLOAT) AS rating,
         CAST(epoch(l.l_shipdate) AS BIGINT) AS "timestamp"
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

MOVIES = """movies AS (
  SELECT CAST(p_partkey AS INTEGER) AS movieId,
         p_name || ' (' || CAST(1950 + p_size AS VARCHAR) || ')' AS title,
         replace(p_name, ' ', '|') AS genres
  FROM part)"""

GENRE_PAIRS = """genre_pairs AS (
  SELECT movieId, unnest(string_split(genres, '|')) AS genre
  FROM movies WHERE genres IS DISTINCT FROM '(no genres listed)')"""

TAGS = """tags AS (
  SELECT CAST(doc_id % 100 AS INTEGER) AS userId,
         CAST(doc_id % (SELECT count(*) FROM part) AS INTEGER) AS movieId,
         source AS tag, CAST(946684800 + doc_id * 86400 AS BIGINT) AS "timestamp"
  FROM documents)"""

LINKS = """links AS (
  SELECT CAST(p_partkey AS INTEGER) AS movieId, CAST(p_partkey + 100000 AS INTEGER) AS imdbId,
         CASE WHEN p_size % 10 <> 0 THEN CAST(p_partkey * 10 AS BIGINT) END AS tmdbId
  FROM part)"""

GENOME_SCORES = """genome_scores AS (
  SELECT CAST(vec_id AS INTEGER) AS movieId, CAST(pos AS SMALLINT) AS tagId,
         CAST((CAST(x AS DOUBLE) + 1.0) / 2.0 AS FLOAT) AS relevance
  FROM (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS pos
        FROM embeddings))"""

GENOME_TAGS = """genome_tags AS (
  SELECT DISTINCT tagId, 'tag-' || CAST(tagId AS VARCHAR) AS tag FROM genome_scores)"""

MOVIES2 = """movies2 AS (
  SELECT CAST(p_partkey AS INTEGER) AS movieId,
         CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || '!'
              WHEN 3 THEN 'The ' || p_name ELSE replace(p_name, ' ', '  ') END AS title,
         replace(p_name, ' ', '|') AS genres,
         CASE WHEN p_size < 50 THEN CAST(1950 + p_size AS VARCHAR) || '-01-01' ELSE '' END AS release_date,
         CAST(p_retailprice AS DOUBLE) / 100.0 AS popularity,
         CAST(p_size % 21 AS DOUBLE) / 2.0 AS vote_average,
         CAST(p_size % 7 AS INTEGER) AS vote_count
  FROM part)"""

RATINGS2 = """ratings2 AS (
  SELECT CAST(CAST('0x' || substr(md5(concat_ws(':', m.movieId, g.v, 42)), 1, 8) AS BIGINT) % 50000 + 1 AS INTEGER) AS userId,
         m.movieId,
         CAST(least(greatest(CAST(round_even(m.vote_average, 0) AS DOUBLE) / 2, 0.5), 5.0) AS FLOAT) AS rating,
         CAST(epoch(try_strptime(m.release_date, '%Y-%m-%d')) AS BIGINT) AS "timestamp"
  FROM movies2 m, LATERAL generate_series(1, m.vote_count) AS g(v)
  WHERE m.vote_count > 0 AND try_strptime(m.release_date, '%Y-%m-%d') IS NOT NULL)"""

RAW_RATINGS = """raw_ratings AS (
  SELECT * FROM ratings
  UNION ALL SELECT * FROM ratings WHERE rating = 5.0
  UNION ALL SELECT userId, movieId, CAST(rating + 5.0 AS FLOAT) AS rating, "timestamp" FROM ratings WHERE rating = 0.5
  UNION ALL SELECT userId, movieId, CAST(NULL AS FLOAT) AS rating, "timestamp" FROM ratings WHERE rating = 1.0)"""

RAW_MOVIES = """raw_movies AS (
  SELECT * FROM movies UNION ALL SELECT * FROM movies WHERE starts_with(genres, 'red|'))"""

EVENTS = """ev AS (SELECT event_id, ts, user_id, event_type, value FROM events)"""

# Domain-table dependencies so a query can ask for what it uses.
_DEPS = {
    "ratings": [], "movies": [], "genre_pairs": ["movies"], "tags": [], "links": [],
    "genome_scores": [], "genome_tags": ["genome_scores"], "movies2": [], "ratings2": ["movies2"],
    "ev": [], "raw_ratings": ["ratings"], "raw_movies": ["movies"],
}
_TEXT = {"ratings": RATINGS, "movies": MOVIES, "genre_pairs": GENRE_PAIRS, "tags": TAGS, "links": LINKS,
         "genome_scores": GENOME_SCORES, "genome_tags": GENOME_TAGS, "movies2": MOVIES2,
         "ratings2": RATINGS2, "ev": EVENTS,
         "raw_ratings": RAW_RATINGS, "raw_movies": RAW_MOVIES}


def with_tables(*names: str, extra: str = "") -> str:
    """``WITH`` clause defining the named domain tables (and their dependencies) plus
    ``extra`` CTE text (comma-separated, without the leading WITH)."""
    order: list[str] = []

    def add(n):
        for d in _DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    ctes = [_TEXT[n] for n in order]
    if extra.strip():
        ctes.append(extra.strip())
    return ("WITH " + ",\n".join(ctes) + "\n") if ctes else ""
