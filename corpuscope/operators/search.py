"""Full-text search over postings, cosine top-k, and their merged ranking."""

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from corpuscope.functions.text import query_words, search_tokens
from corpuscope.functions.vectors import cosine, embed_text, has_embedding
from corpuscope.operators.nearest import SCORE_DIGITS, VectorIndex
from corpuscope.schemas import DEFAULT_SID, EMBEDDING_DIM
from corpuscope.session import rows_if_at_most, staged
from corpuscope.sources.postings import BLOCK_BITS, opened

FILE_THRESHOLD = 0.01
DECISION_THRESHOLD = 0.1
TEXT_HIT_SCORE = 0.99
# A query batch up to this size is broadcast as one matrix (4 MB); more go through a metric index.
MAX_BROADCAST_QUERIES = 4096
# Rows, and queries, whose matrix of scores a task holds at a time (4 MB, and as much again for each step).
SCORED_ROWS, SCORED_QUERIES = 2048, 256


# --- inverted index ----------------------------------------------------------------------

def build_postings(files: DataFrame) -> DataFrame:
    """(token, file_path, field, pos, sid): every token of path, content and session.

    One scan, no shuffle. A filter on `token` placed on the result runs before anything
    is shuffled, so a search over raw files moves only the query's own tokens."""
    def field(name):
        return F.struct(F.lit(name).alias("field"), search_tokens(F.col(name)).alias("tokens"))

    rows = files.withColumn("sid", F.coalesce("sid", F.lit(DEFAULT_SID)))
    fields = rows.select("file_path", "sid", F.inline(F.array(*map(field, ("file_path", "content", "sid")))))
    return fields.select("file_path", "field", "sid", F.posexplode("tokens").alias("pos", "token")).select(
        "token", "file_path", "field", "pos", "sid")


def write_postings(postings: DataFrame, path: str) -> None:
    """Sorted by token, so parquet statistics skip row groups of other tokens. The range
    key goes on with the path, which splits a token that holds much of the corpus."""
    postings.repartitionByRange("token", "file_path").sortWithinPartitions("token", "file_path", "pos").write.parquet(path)


def token_counts(postings: DataFrame) -> DataFrame:
    """Documents per token over all fields."""
    in_file = postings.groupBy("token", "file_path").count()
    return in_file.groupBy("token").agg(F.count("*").alias("documents"), F.sum("count").alias("occurrences"))


def _terms(*terms: str):
    return [t for t in dict.fromkeys(terms)]


def match_all(postings: DataFrame, *terms: str) -> DataFrame:
    """Files that contain every term; one flag per term, combined before the shuffle."""
    terms = _terms(*terms)
    flags = [F.bool_or(F.col("token") == t).alias(f"has_{i}") for i, t in enumerate(terms)]
    per_file = postings.where(F.col("token").isin(terms)).groupBy("file_path").agg(*flags)
    for i in range(len(terms)):
        per_file = per_file.where(F.col(f"has_{i}"))
    return per_file.select("file_path")


def match_any(postings: DataFrame, *terms: str) -> DataFrame:
    return postings.where(F.col("token").isin(_terms(*terms))).select("file_path").distinct()


def match_not(hits: DataFrame, excluded: DataFrame) -> DataFrame:
    return hits.join(excluded, "file_path", "left_anti")


def match_phrase(postings: DataFrame, *terms: str) -> DataFrame:
    """Files with the terms on consecutive positions of one field."""
    places = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(i).alias("i")) for i, t in enumerate(terms)])
    hits = postings.where(F.col("token").isin(_terms(*terms))).select(
        "file_path", "field", "pos", F.explode(F.filter(places, lambda p: p["token"] == F.col("token"))).alias("p"))
    starts = hits.groupBy("file_path", "field", (F.col("pos") - F.col("p.i")).alias("start")).count()
    return starts.where(F.col("count") == len(terms)).select("file_path").distinct()


def match_prefix(postings: DataFrame, prefix: str) -> DataFrame:
    return postings.where(F.col("token").startswith(prefix)).select("file_path").distinct()


def match_field(postings: DataFrame, field: str) -> DataFrame:
    """Postings of one field, to be passed to any other match."""
    return postings.where(F.col("field") == field)


def in_session(hits: DataFrame, snapshots: DataFrame, sid: str) -> DataFrame:
    """Hits whose file belongs to the session."""
    return hits.join(snapshots.where(F.col("sid") == sid).select("file_path"), "file_path", "left_semi")


def _query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, query_sid, n_words, word_no, n_tokens, token_no, token) of plain queries."""
    words = queries.select("query_id", F.col("sid").alias("query_sid"), F.filter(
        F.transform(query_words(F.col("query_text")), search_tokens), lambda t: F.size(t) > 0).alias("words"))
    words = words.select("query_id", "query_sid", F.size("words").alias("n_words"),
                         F.posexplode("words").alias("word_no", "tokens"))
    return words.select("query_id", "query_sid", "n_words", "word_no", F.size("tokens").alias("n_tokens"),
                        F.posexplode("tokens").alias("token_no", "token"))


def _rarest(tokens: DataFrame, frequency: DataFrame) -> DataFrame:
    """The rarest token of each query, by (token, n)."""
    return tokens.join(frequency, "token", "left").groupBy("query_id", "query_sid").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))


def _in_session() -> Column:
    return F.col("query_sid").isNull() | (F.col("query_sid") == F.col("sid"))


def _holding_all(wanted: DataFrame, occurrences: DataFrame, file: str) -> DataFrame:
    """(query_id, `file`, sid) where every word of the query was found. `wanted` has the tokens to look up in
    candidate files; a word of several tokens has to appear as a phrase."""
    single = F.col("n_tokens") == 1
    word = ["query_id", file, "sid", "n_words", "word_no"]
    found = wanted.where(single).join(occurrences.select(file, "token"), [file, "token"], "left_semi").select(*word)
    phrases = wanted.where(~single).join(occurrences.select(file, "token", "field", "pos"), [file, "token"])
    starts = phrases.groupBy(*word, "n_tokens", "field", (F.col("pos") - F.col("token_no")).alias("start")).count()
    found = found.unionByName(starts.where(F.col("count") == F.col("n_tokens")).select(*word))
    per_file = found.groupBy("query_id", file, "sid", "n_words").agg(F.count_distinct("word_no").alias("found"))
    return per_file.where(F.col("found") == F.col("n_words")).select("query_id", file, "sid")


def text_hits(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, file_path, sid) where a file holds every word of a plain query.

    One pass over `postings` keeps the rows of the asked tokens, in a table; the rest works on that.
    Starts from the rarest token of each query: only files with that token are candidates,
    and only for them are the other words looked up. A word of several tokens (`a_b`) has to
    appear as a phrase. Queries that are not plain word lists hit nothing, as they would be
    rejected (see `query_words`)."""
    # stored, so that its size is known: the asked tokens go to the postings, not the postings to them
    tokens = staged(_query_tokens(queries), "asked-tokens")
    held = staged(postings.join(tokens.select("token").distinct(), "token", "left_semi"), "asked-postings")
    rarest = _rarest(tokens, held.groupBy("token").agg(F.count("*").alias("n")))
    candidates = held.join(rarest, "token").where(_in_session()).select("query_id", "file_path", "sid").distinct()
    # one query may ask several sessions, in a row for each
    wanted = staged(candidates.join(tokens.drop("query_sid").distinct(), "query_id"), "wanted")
    return _holding_all(wanted, held, "file_path")


def stored_text_hits(index, queries: DataFrame) -> DataFrame:
    """`text_hits` from a stored index (`sources.postings.StoredPostings`).

    Of the asked tokens' buckets, the sizes of blocks say which token of a query is rarest. Only its
    blocks are opened for candidates; of the other tokens, only the blocks with a candidate's number."""
    tokens = staged(_query_tokens(queries), "asked-tokens")
    held = index.blocks(tokens.select("token"))
    rarest = _rarest(tokens, held.groupBy("token").agg(F.sum("n_occurrences").alias("n")))
    of_rarest = opened(held.join(rarest, "token"), "query_id", "query_sid")
    candidates = staged(of_rarest.select("query_id", "query_sid", "file_no").distinct().join(index.files(), "file_no")
                        .where(_in_session()).select("query_id", "file_no", "file_path", "sid").distinct(), "candidates")
    wanted = staged(candidates.drop("file_path").join(tokens.drop("query_sid").distinct(), "query_id"), "wanted")
    asked = wanted.select("token", F.shiftright("file_no", BLOCK_BITS).alias("block")).distinct()
    hits = _holding_all(wanted, opened(held.join(asked, ["token", "block"], "left_semi")), "file_no")
    return hits.drop("sid").join(candidates, ["query_id", "file_no"]).select("query_id", "file_path", "sid").distinct()


def _asked_clauses(queries: DataFrame):
    """(clauses, one row per asked token) of queries with `clauses`."""
    clauses = queries.select("query_id", F.posexplode("clauses").alias("clause", "c")).select(
        "query_id", "clause", "c.op", "c.field", "c.tokens", F.size("c.tokens").alias("n"))
    asked = clauses.select("query_id", "clause", "op", F.col("field").alias("in_field"), "n",
                           F.posexplode("tokens").alias("token_no", "token"))
    return clauses, asked


def _grown(asked: DataFrame, known: DataFrame) -> DataFrame:
    """`asked` with each prefix as the tokens of `known` (token) that begin with it; they meet on their first letter."""
    begins = asked.where("op = 'prefix'").withColumnRenamed("token", "prefix").withColumn("letter", F.left("prefix", F.lit(1)))
    grown = begins.join(known.withColumn("letter", F.left("token", F.lit(1))), "letter").where(F.startswith("token", F.col("prefix")))
    plain = asked.where("op <> 'prefix'")
    return plain.unionByName(grown.select(*plain.columns))


def clause_hits(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, file_path, sid) for a batch of queries (query_id, clauses[, sid]) with
    clauses array<struct<op, field, tokens>>.

    A file is hit if every clause holds that is not a `not`, and no `not` does: `all` tokens, `any`
    token, the tokens as a `phrase`, any token beginning with one of them (`prefix`), none of them
    (`not`). A clause with a `field` looks only there. Tokens are as `search_tokens` makes them. A
    query of `not` clauses alone hits nothing. With a `sid` only files of that session are hit; a
    query may have a row for each of several sessions, with the same clauses."""
    clauses, asked = _stored_clauses(queries)
    held = staged(_asked_postings(postings, asked), "asked-postings")
    return _clauses_in(held, clauses, staged(_grown(asked, held.select("token").distinct()), "grown-clauses"), queries)


def _stored_clauses(queries: DataFrame):
    """`_asked_clauses` of a stored table of the queries: its size then says how they meet the postings."""
    return _asked_clauses(staged(queries.select("query_id", "clauses").distinct(), "asked-clauses"))


def _asked_postings(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings of asked tokens and of those that begin with an asked prefix, in one pass."""
    plain = asked.where("op <> 'prefix'").select("token").distinct().withColumn("is_asked", F.lit(True))
    begins = asked.where("op = 'prefix'").groupBy(F.left("token", F.lit(1)).alias("letter")).agg(F.collect_set("token").alias("prefixes"))
    met = postings.withColumn("letter", F.left("token", F.lit(1))).join(plain, "token", "left").join(begins, "letter", "left")
    like = F.exists("prefixes", lambda p: F.startswith(F.col("token"), p))
    return met.where(F.coalesce("is_asked", like, F.lit(False))).select(*postings.columns)


def stored_clause_hits(index, queries: DataFrame) -> DataFrame:
    """`clause_hits` from a stored index: only the buckets of the asked tokens are opened, and the
    vocabulary, without any entry, where there are prefixes."""
    clauses, asked = _stored_clauses(queries)
    tokens = staged(_grown(asked, index.vocabulary().select("token")), "asked-clauses")
    held = staged(index.postings(index.blocks(tokens.select("token"))), "asked-postings")
    return _clauses_in(held, clauses, tokens, queries)


def _clauses_in(postings: DataFrame, clauses: DataFrame, asked: DataFrame, queries: DataFrame) -> DataFrame:
    in_field = F.col("in_field").isNull() | (F.col("in_field") == F.col("field"))
    # only phrases ask where in a file a token stands
    in_files = postings.select("token", "file_path", "field", "sid").distinct()
    in_files = in_files.join(asked.where("op <> 'phrase'"), "token").where(in_field)
    found = postings.join(asked.where("op = 'phrase'"), "token").where(in_field)
    key = ["query_id", "clause", "op", "n", "file_path", "sid"]
    loose = in_files.groupBy(*key).agg(F.count_distinct("token_no").alias("have"))
    loose = loose.where("op <> 'all' or have = n").select(*key)
    starts = found.groupBy(*key, "field", (F.col("pos") - F.col("token_no")).alias("start")).count()
    phrases = starts.where("count = n").select(*key).distinct()
    wanted = clauses.groupBy("query_id").agg(F.count_if(F.col("op") != "not").alias("wanted"))
    per_file = loose.unionByName(phrases).groupBy("query_id", "file_path", "sid").agg(
        F.count_if(F.col("op") != "not").alias("held"), F.count_if(F.col("op") == "not").alias("refused"))
    hits = per_file.join(wanted, "query_id").where("refused = 0 and held = wanted").select("query_id", "file_path", "sid")
    if "sid" not in queries.columns:
        return hits
    # a query that names no session asks all
    sessions = queries.select("query_id", F.col("sid").alias("query_sid")).distinct()
    return hits.join(sessions, "query_id").where(_in_session()).select("query_id", "file_path", "sid").distinct()


# --- cosine top-k ------------------------------------------------------------------------

def _embedded(queries: DataFrame) -> DataFrame:
    """Queries (query_id, query_text[, sid]) with vectors; a NULL sid asks the whole corpus, and
    a query may have a row for each of several sessions."""
    sid = F.col("sid") if "sid" in queries.columns else F.lit(None).cast("string")
    vector = F.col("embedding") if "embedding" in queries.columns else embed_text(F.col("query_text"))
    text = F.col("query_text") if "query_text" in queries.columns else F.lit(None).cast("string")
    return queries.select("query_id", sid.alias("sid"), text.alias("query_text"), vector.alias("embedding"))


def _unit_rows(vectors):
    import numpy as np

    return vectors, np.sqrt((vectors * vectors).sum(axis=1))


def _batch_top_k(table, q_ids, q_sids, q_vectors, tie, k, threshold):
    """Best `k` rows per ranking (a query, or a query in one session) of one Arrow table.

    The best of the whole are among the best of its parts, so a part drops the rest
    before anything is shuffled."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    width = q_vectors.shape[1]
    # Rows without a vector of the right width take no part. The test is made here: as a
    # filter on the column it would make Spark run an embedding function twice.
    table = table.filter(pc.equal(pc.list_value_length(table.column("embedding")), width))
    if table.num_rows == 0:
        return None
    table = table.sort_by([(tie, "ascending")])
    embedding = table.column("embedding").combine_chunks()
    vectors = embedding.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    vectors, norms = _unit_rows(vectors)
    q_vectors, q_norms = _unit_rows(q_vectors)
    names = {s: i for i, s in enumerate(sorted({s for s in q_sids if s is not None}))}
    # numbers of the asked sessions: -1 asks the whole corpus, -2 is asked by nobody
    asked = np.array([names.get(s, -1) for s in q_sids])
    own = np.array([names.get(s, -2) for s in table.column("sid").to_pylist()])
    rows, queries, scores = [], [], []
    for q0 in range(0, len(q_ids), SCORED_QUERIES):
        part = slice(q0, q0 + SCORED_QUERIES)
        sims = vectors @ q_vectors[part].T / (np.outer(norms, q_norms[part]) + 1e-8)
        takes = (sims > threshold) & ((asked[part] == -1) | (asked[part] == own[:, None]))
        rounded = np.where(takes, np.round(sims, SCORE_DIGITS), -np.inf)
        best = np.argsort(-rounded, axis=0, kind="stable")[:k]
        kept, column = np.nonzero(np.take_along_axis(rounded, best, axis=0) > -np.inf)
        picked = best[kept, column]
        rows.append(picked)
        queries.append(column + q0)
        scores.append(rounded[picked, column])
    rows, queries, scores = map(np.concatenate, (rows, queries, scores))
    out = table.drop_columns(["embedding"]).take(pa.array(rows))
    out = out.append_column("query_id", q_ids.take(pa.array(queries)))
    out = out.append_column("asked_sid", pa.array(q_sids, pa.string()).take(pa.array(queries)))
    return out.append_column("score", pa.array(scores, pa.float64()))


def _ranked(candidates: DataFrame, tie: str, k: int) -> DataFrame:
    """Rank per query, or per query and session it names; Spark limits each task to k rows per group first."""
    order = Window.partitionBy("query_id", "asked_sid").orderBy(F.desc("score"), F.asc(tie))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("asked_sid")


def cosine_top_k(corpus: DataFrame, queries: DataFrame, tie: str, k: int, threshold: float,
                 width: int = EMBEDDING_DIM, max_broadcast: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """The k best corpus rows per query with cosine above `threshold`.

    A query without a session has one ranking over the corpus; a row of a query that names a
    session has its own ranking over that session.

    `corpus` has `sid`, a unique column `tie`, `embedding` and any columns to carry along.
    Scores are rounded to `SCORE_DIGITS`; equal scores are ordered by `tie`.

    A query batch of checked size is broadcast as a matrix: one pass over the corpus, one
    matrix product per Arrow batch, and only each batch's best rows are shuffled. For a larger
    batch the corpus is put in a metric index (`operators.nearest`), and each query meets only the
    rows that its bounds do not rule out. Carry only narrow columns, and join texts to the
    ranked rows. A corpus that is searched often is better indexed once."""
    spark = corpus.sparkSession
    carried = [c for c in corpus.columns if c != "embedding"]
    corpus = corpus.select(*carried, "embedding")
    schema = T.StructType([corpus.schema[c] for c in carried] + [
        queries.schema["query_id"], T.StructField("asked_sid", T.StringType()), T.StructField("score", T.DoubleType())])
    id_type = to_arrow_type(queries.schema["query_id"].dataType)
    # vectors of another width ask for nothing, in either plan
    asked = _embedded(queries).select("query_id", "sid", "embedding").where(F.size("embedding") == width)
    small = rows_if_at_most(asked, max_broadcast)
    if small is not None:
        import numpy as np

        if not small:
            return _ranked(spark.createDataFrame([], schema), tie, k)
        packed = spark.sparkContext.broadcast((
            [r["query_id"] for r in small], [r["sid"] for r in small],
            np.array([r["embedding"] for r in small], dtype=np.float64)))

        def score(batches):
            import pyarrow as pa

            ids, sids, vectors = packed.value
            ids = pa.array(ids, id_type)
            for batch in batches:
                for begin in range(0, batch.num_rows, SCORED_ROWS):
                    best = _batch_top_k(pa.Table.from_batches([batch.slice(begin, SCORED_ROWS)]), ids, sids, vectors, tie, k, threshold)
                    if best is not None:
                        yield from best.select(schema.names).to_batches()

        return _ranked(corpus.mapInArrow(score, schema), tie, k)

    found, _ = VectorIndex(corpus, tie, width).top_k(asked, k, threshold)
    return _ranked(found.select(*schema.names), tie, k)


def similar_files_by_vector(snapshots: DataFrame, queries: DataFrame, k: int = 10,
                            threshold: float = FILE_THRESHOLD, **plan) -> DataFrame:
    corpus = snapshots.select("sid", "file_path", "embedding")
    return cosine_top_k(corpus, queries, "file_path", k, threshold, **plan).select(
        "query_id", "sid", "file_path", "score", "rank")


def similar_files(snapshots: DataFrame, postings: DataFrame, queries: DataFrame, k: int = 10,
                  threshold: float = FILE_THRESHOLD, **plan) -> DataFrame:
    """Cosine hits merged with text hits, best k per ranking (see `cosine_top_k`).

    Text hits are those of the query text as a plain word list (`text_hits`), or, where `queries`
    has a column `clauses`, of its clauses; either in the sessions that the query names. `postings` are
    rows of `build_postings` or a stored index.

    A file in both lists keeps its cosine score; a file found by text alone scores 0.99.
    The merged best k are the best of (cosine best k, text-only hits), so the full cosine
    list is never formed: only text hits are checked against the threshold. `snapshots` is
    read twice: give a stored table, not one that embeds on the fly."""
    stored = not isinstance(postings, DataFrame)
    by_words, by_clauses = (stored_text_hits, stored_clause_hits) if stored else (text_hits, clause_hits)
    asked = _embedded(queries)
    named = asked.groupBy("query_id").agg(F.bool_and(F.col("sid").isNotNull()).alias("named"))
    ranking = lambda rows: rows.join(named, "query_id").withColumn("asked_sid", F.when(F.col("named"), F.col("sid"))).drop("named")
    by_vector = ranking(similar_files_by_vector(snapshots, asked, k, threshold, **plan).drop("rank"))
    if "clauses" in queries.columns:
        hits = by_clauses(postings, asked.select("query_id", "sid").join(queries.select("query_id", "clauses").distinct(), "query_id"))
    else:
        hits = by_words(postings, asked)
    hits = hits.select("query_id", "file_path").distinct()
    vectors = asked.select("query_id", F.col("embedding").alias("query_embedding")).dropDuplicates(["query_id"])
    text_only = (
        hits.join(snapshots.select("file_path", "sid", "embedding"), "file_path").join(vectors, "query_id")
        .where(~has_embedding(F.col("embedding"))
               | (cosine(F.col("embedding"), F.col("query_embedding")) <= threshold))
        .select("query_id", "sid", "file_path", F.lit(TEXT_HIT_SCORE).alias("score")))
    return _ranked(by_vector.unionByName(ranking(text_only)), "file_path", k)


def search_decisions(decisions: DataFrame, queries: DataFrame, k: int = 20,
                     threshold: float = DECISION_THRESHOLD, **plan) -> DataFrame:
    """Best decisions per ranking over the embedding of key, value and rationale.

    Only ids and vectors are ranked; texts are joined to the few ranked rows. `decisions` is read
    twice, the second time without vectors."""
    found = cosine_top_k(decisions.select("sid", "node_id", "embedding"), queries, "node_id", k, threshold, **plan)
    texts = decisions.select(F.col("sid").alias("_sid"), "node_id", "key", "value")
    return found.join(texts, ["node_id"]).where(F.col("sid").eqNullSafe(F.col("_sid"))).select(
        "query_id", "sid", "node_id", "key", "value", "score", "rank")


def shown(ranked: DataFrame) -> DataFrame:
    """The score as a whole percentage, as it is presented."""
    return ranked.withColumn("percent", F.round(F.col("score") * 100).cast("int"))
