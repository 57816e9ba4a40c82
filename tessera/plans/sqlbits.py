"""Small SQL fragments shared by the DuckDB oracle statements (same
definitions as the Spark column functions, written independently)."""


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def tok(x: str) -> str:
    """Lower-cased word tokens of ``x`` (letters, marks, digits)."""
    return (f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), "
            f"'[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda t: t <> '')")


def clean(x: str) -> str:
    """Whitespace runs to one space, trimmed; NULL -> ''."""
    return (f"trim(regexp_replace(coalesce({x}, ''), "
            f"'[\\s\\p{{Z}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+', ' ', 'g'))")


def qa_pairs() -> str:
    """User turn joined with the next assistant turn."""
    return ("(SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer "
            "FROM conversations u JOIN conversations a "
            "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
            "WHERE u.role = 'user' AND a.role = 'assistant')")


BM25_CTES = """
bm_docs AS (
  SELECT doc_id, {tok_doc} AS toks FROM documents WHERE coalesce(text, '') <> ''
),
bm_stats AS (SELECT count(*)::DOUBLE AS n, avg(len(toks))::DOUBLE AS avgdl FROM bm_docs),
bm_tf AS (
  SELECT doc_id, dl, term, count(*) AS tf
  FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM bm_docs) GROUP BY doc_id, dl, term
),
bm_df AS (SELECT term, count(*) AS df FROM bm_tf GROUP BY term),
bm_post AS (
  SELECT f.term, f.doc_id, f.tf,
         ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * f.tf * 2.5
           / (f.tf + 1.5 * (0.25 + 0.75 * f.dl / s.avgdl)) AS weight
  FROM bm_tf f JOIN bm_df d USING (term), bm_stats s
)
""".format(tok_doc=tok("' ' || coalesce(text, '')"))


def bm25_query_terms(source: str, id_col: str, text_col: str) -> str:
    return (f"SELECT {id_col} AS query_id, term, count(*) AS qtf FROM "
            f"(SELECT {id_col}, unnest({tok(text_col)}) AS term FROM {source}) GROUP BY 1, 2")


def hash_vectors(source: str, id_col: str, text_col: str, dim: int = 64) -> str:
    """Sparse cells (id, b, v) of the L2-normalised signed hashing vector."""
    toks = tok(f"trim(replace(coalesce({text_col}, ''), chr(10), ' '))")
    return f"""(
  WITH ht AS (SELECT {id_col} AS id, unnest({toks}) AS t FROM {source}),
  hc AS (SELECT id, (('0x' || substr(md5(t), 1, 8))::BIGINT % {dim})::INT AS b,
                sum(CASE WHEN ('0x' || substr(md5(t), 9, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v
         FROM ht GROUP BY 1, 2),
  hn AS (SELECT id, sqrt(sum(v * v)) AS n FROM hc GROUP BY 1)
  SELECT hc.id, hc.b, hc.v / hn.n AS v FROM hc JOIN hn USING (id) WHERE hn.n > 0
)"""


def dense_dot(queries: str, points: str, dim: int = 64) -> str:
    """(query_id, point_id, score) for two tables of FLOAT[] vectors."""
    return f"""(
  SELECT q.qid AS query_id, p.pid AS point_id,
         list_sum(list_transform(range(1, {dim} + 1), lambda i: q.vec[i]::DOUBLE * p.vec[i]::DOUBLE)) AS score
  FROM {queries} q, {points} p
)"""
