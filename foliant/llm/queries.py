"""The queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    bi AS (SELECT item, ws, unnest(range(1, CAST(greatest(len(ws) - 9, 1) AS BIGINT) + 1)) AS s FROM b WHERE len(ws) > 0),
    w AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(list_slice(ws, s, s + 9), ' ') AS k FROM bi),
    di AS (SELECT doc_id, ws, n, unnest(range(1, CAST(greatest(len(ws) - n + 1, 0) AS BIGINT) + 1)) AS s FROM d, (SELECT DISTINCT n FROM w) AS z),
    h AS (SELECT di.doc_id, di.s, di.n, w.item FROM di JOIN w ON w.n = di.n AND w.k = array_to_string(list_slice(ws, s, s + di.n - 1), ' ')),
    c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM h) AS covered GROUP BY doc_id),
    i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) AS named GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id"""


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


SHARDS = [f"shard-{i:02d}" for i in range(16)]


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import counted_components

    rows = counted_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, part=90, whole=100)
    return rows.withColumnRenamed("doc", "doc_id")


OP2_SQL = r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p, greatest(len(ws) - 2, 1) AS n FROM d),
    s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, p, n, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k FROM u) AS runs WHERE p <= n),
    z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s AS a JOIN s AS b ON a.k = b.k GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b, m = x.n AND m = y.n AS equal FROM c JOIN z AS x ON x.doc_id = a JOIN z AS y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
    e AS (SELECT a, min(b) AS name FROM l WHERE equal GROUP BY a),
    k AS (SELECT l.a, CAST(count(DISTINCT e.name) - 1 AS BIGINT) AS n_links FROM l JOIN e ON e.a = l.b GROUP BY l.a),
    r AS (SELECT doc_id AS a, doc_id AS m FROM d UNION SELECT l.b AS a, r.m FROM r JOIN l ON l.a = r.a)
    SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, t.component_id, coalesce(k.n_links, 0) AS n_links
    FROM d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN k ON k.a = d.doc_id JOIN (SELECT a, min(m) AS component_id FROM r GROUP BY a) AS t ON t.a = d.doc_id"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), network).select("doc_id", "held_out", "lang_pred", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


def op6_sql() -> str:
    """Placement in SQL; the table, which is filled in turns, is a literal of two hexadecimal digits a slot."""
    from .sharding import SLOTS, fill_table

    owners = "".join(f"{x:02x}" for x in fill_table(SHARDS))
    return f"""
        WITH t AS (SELECT '{owners}' AS owners),
        d AS (SELECT doc_id, coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), 'null') AS k FROM documents),
        s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(k), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM d)
        SELECT doc_id, slot, CAST(CAST('0x' || substr(t.owners, 2 * slot + 1, 2) AS BIGINT) AS INTEGER) AS shard FROM s, t"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_boilerplate

    clean = drop_boilerplate(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = """
    WITH d AS (SELECT doc_id, coalesce('h' || source, '') AS host, string_split(text, chr(10)) AS lines FROM documents),
    pages AS (SELECT host, count(*) AS pages FROM d WHERE lines IS NOT NULL GROUP BY host HAVING count(*) >= 20),
    l AS (SELECT DISTINCT doc_id, host, trim(line, ' ' || chr(9) || chr(13)) AS line FROM (SELECT doc_id, host, unnest(lines) AS line FROM d)),
    n AS (SELECT host, line, count(*) AS n FROM l WHERE line <> '' GROUP BY host, line HAVING count(*) > 1),
    b AS (SELECT n.host, list(line) AS bad FROM n JOIN pages USING (host) WHERE n > pages * CAST(0.1 AS DOUBLE) GROUP BY n.host),
    k AS (SELECT doc_id, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))) END AS kept
          FROM d LEFT JOIN b ON d.host = b.host)
    SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
           CASE WHEN lines IS NOT NULL THEN sha256(coalesce(array_to_string(kept, chr(10)), '')) END AS kept_sha256
    FROM k"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import drop_repeats

    rows = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p, len(ws) AS n FROM d),
    k AS (SELECT *, p <= n - 19 AS starts, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS key FROM u),
    f AS (SELECT doc_id, w, p, starts AND row_number() OVER (PARTITION BY starts, key ORDER BY doc_id, p) > 1 AS later FROM k),
    g AS (SELECT doc_id, w, p, bool_or(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
    t AS (SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN t ON t.doc_id = d.doc_id"""


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .class_lm import held_out, score, train, training

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = train(docs.where(training()))
    found = score(docs, model, counts).withColumn("held_out", held_out())
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, packed_table, write_packed
    from .storage import shared_folder

    path = f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    write_packed(pack(table(spark, sf_dir, "documents"), tokenizer_path()), path)
    rows = packed_table(spark, path)
    return rows.select(
        F.element_at("cu_seqlens", -1).alias("n_tokens"),
        F.size("segments").alias("n_segments"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "cu_seqlens",
        "resets",
        F.col("segments.doc").alias("doc_ids"),
        F.col("segments.piece").alias("pieces"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
                 || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
                 || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                 || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
          FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
    g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, fails),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f AS a, f AS b, f AS c, f AS d, f AS e
          WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
    s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) AS r(step)),
    x AS (SELECT g.*, s.*, contains(fails, f) AS hit, length(translate(fails, earlier, '')) < length(fails) AS gone FROM g, s),
    r AS (SELECT part, filter_order, step, any_value(f) AS f, sum(n) FILTER (WHERE NOT hit AND NOT gone) AS kept, sum(n) FILTER (WHERE hit AND NOT gone) AS removed,
                 sum(n) FILTER (WHERE hit AND gone) AS redundant, sum(n) FILTER (WHERE fails = f) AS unique_fails,
                 sum(good) FILTER (WHERE hit AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE hit AND NOT gone) AS toxic_lost
          FROM x GROUP BY part, filter_order, step)
    SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
           CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
           CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
    FROM r"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_sql(rounds: int = 6) -> str:
    """The rounds one after the other; a distance and an index are one number, so that the least of them settles ties."""
    steps = """
    k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS v FROM k, range(8) AS r(p)),
    b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16)),"""
    for r in range(rounds + 1):
        steps += f"""
    a{r} AS MATERIALIZED (SELECT vec_id, x.p, any_value(v) AS v, min(list_sum(list_transform(v, lambda y, i: (y - c[i]) * (y - c[i]))) * 16 + e) AS m FROM x JOIN b{r} USING (p) GROUP BY vec_id, x.p),"""
        if r < rounds:
            steps += f"""
    s{r} AS (SELECT p, e, d, sum(y) AS t, count(*) AS n FROM (SELECT p, m % 16 AS e, unnest(v) AS y, unnest(range(1, len(v) + 1)) AS d FROM a{r}) AS u GROUP BY p, e, d),
    n{r} AS (SELECT p, e, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY d) AS c FROM s{r} GROUP BY p, e),
    b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN n{r} USING (p, e)),"""
    return f"""
    WITH {steps}
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
    f AS (SELECT vec_id, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN k USING (vec_id), h"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import BASE, judge

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carried=["doc_id"]).select("doc_id", *BASE, "base_failed", "kept")


def op13_sql() -> str:
    """The same estimates, each step a few tables; sums are whole numbers and everything else single operations of doubles."""
    from .quality_rules import BINS, CONSISTENT, CONSISTENT_REWEIGHTED, CUTOFF, GRID, LARGEST, MAD, PAIRS, PSEUDO, PSEUDO_LENGTH, REWEIGHT, RIDGE, STEPS, D

    real = lambda x: f"CAST({x} AS DOUBLE)"
    each = lambda text: ", ".join(text.format(i=i) for i in range(D))
    both = lambda text: ", ".join(text.format(i=i, j=j) for i, j in PAIRS)
    sums = f"count(*) AS m, {each('sum(v{i}) AS s{i}')}, {both('sum(v{i} * v{j}) AS q{i}{j}')}"
    tables = []

    def factored(name: str, source: str, covariance: dict[str, str], means: str) -> None:
        """Tables for one column of the root after the other."""
        tables.append(f"{name}c AS (SELECT g, start, n, {means}, {', '.join(f'{v} AS c{k}' for k, v in covariance.items())} FROM {source})")
        before = f"{name}c"
        for i, j in sorted(PAIRS, key=lambda p: (p[1], p[0])):
            rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            value = f"sqrt(greatest({rest}, {real(1)}))" if i == j else f"({rest}) / l{j}{j}"
            tables.append(f"{name}{i}{j} AS (SELECT *, {value} AS l{i}{j} FROM {before})")
            before = f"{name}{i}{j}"
        tables.append(f"{name} AS MATERIALIZED (SELECT *, l00 * l11 * l22 * l33 AS det FROM {before})")

    def estimate(name: str, source: str, factor: float) -> None:
        tables.append(f"{name}m AS (SELECT g, start, n, {each(f'{real("s{i}")} / m AS mu{{i}}')}, {both(f'{real("q{i}{j}")} / m AS q{{i}}{{j}}')} FROM (SELECT * REPLACE ({real('m')} AS m) FROM {source}) AS u)")
        factored(name, f"{name}m", {f"{i}{j}": f"(q{i}{j} - mu{i} * mu{j}) * {real(factor)} + {real(RIDGE**2 if i == j else 0)}" for i, j in PAIRS}, each("mu{i}"))

    def measured(name: str, state: str) -> None:
        tables.append(f"{name}y AS (SELECT x.*, {state}.* EXCLUDE (g) FROM x JOIN {state} ON {state}.g = x.g)")
        before = f"{name}y"
        for i in range(D):
            rest = f"x{i} - mu{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i))
            tables.append(f"{name}{i} AS (SELECT *, ({rest}) / l{i}{i} AS y{i} FROM {before})")
            before = f"{name}{i}"
        tables.append(f"{name} AS MATERIALIZED (SELECT id, g, start, {each('x{i}')}, y0 * y0 + y1 * y1 + y2 * y2 + y3 * y3 AS d2 FROM {before})")

    x = [f"CAST(least(floor({GRID} * sqrt({real(top)} / {real(f'n_words + {PSEUDO}')}) + {real(0.5)}), {LARGEST}) AS BIGINT)" for top in (f"word_chars + {PSEUDO * PSEUDO_LENGTH}", "n_symbols", "n_dup_lines", "n_repeat_words")]
    tables.append(f"x AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY lang, source) AS g, {', '.join(f'{v} AS x{i}' for i, v in enumerate(x))} FROM s WHERE NOT base_failed)")
    tables.append(f"med AS (SELECT g, count(*) AS n, {each('quantile_cont(x{i}, 0.5) AS mu{i}')} FROM x GROUP BY g)")
    tables.append(f"mad AS (SELECT x.g, 0 AS start, any_value(n) AS n, {each('any_value(mu{i}) AS mu{i}')}, {each('quantile_cont(abs(x{i} - mu{i}), 0.5) AS mad{i}')} FROM x JOIN med ON med.g = x.g GROUP BY x.g)")
    gap = lambda i: f"mad{i} * {real(MAD)} * (mad{i} * {real(MAD)}) + {real(RIDGE**2)}"
    factored("b0", "mad", {f"{i}{j}": gap(i) if i == j else real(0) for i, j in PAIRS}, each("mu{i}"))
    near = "least(greatest(x{i}, floor(mu{i}) - floor(2 * sqrt(c{i}{i}))), floor(mu{i}) + floor(2 * sqrt(c{i}{i})))"
    tables.append(f"clip AS (SELECT x.g, n, {each(f'CAST({near} AS BIGINT) AS v{{i}}')} FROM x JOIN b0 ON b0.g = x.g)")
    tables.append(f"e1 AS (SELECT g, 1 AS start, any_value(n) AS n, {sums} FROM clip GROUP BY g)")
    tables.append(f"e2 AS (SELECT g, 2 AS start, count(*) AS n, {sums} FROM (SELECT g, {each('x{i} AS v{i}')} FROM x) AS u GROUP BY g)")
    estimate("b1", "e1", 1.0)
    estimate("b2", "e2", 1.0)
    columns = f"g, start, n, det, {each('mu{i}')}, {both('l{i}{j}')}"
    tables.append(f"t0 AS MATERIALIZED (SELECT {columns} FROM b0 UNION ALL SELECT {columns} FROM b1 UNION ALL SELECT {columns} FROM b2)")
    for step in range(STEPS):
        measured(f"d{step}", f"t{step}")
        tables.append(f"k{step} AS (SELECT *, CAST(floor({BINS} * (sqrt(d2) / (sqrt(d2) + 4))) AS INTEGER) AS bin FROM d{step})")
        tables.append(f"o{step} AS (SELECT *, rank() OVER (PARTITION BY g, start ORDER BY bin) - 1 AS earlier, count(*) OVER (PARTITION BY g, start) AS n FROM k{step})")
        tables.append(f"e{step}n AS (SELECT g, start, any_value(n) AS n, {sums} FROM (SELECT g, start, n, {each('x{i} AS v{i}')} FROM o{step} WHERE earlier * 4 < n * 3) AS u GROUP BY g, start)")
        estimate(f"r{step}", f"e{step}n", CONSISTENT)
        tables.append(f"t{step + 1} AS MATERIALIZED (SELECT {columns} FROM r{step})")
    tables.append(f"best AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY det, start) AS place FROM t{STEPS}) AS u WHERE place = 1)")
    measured("near", "best")
    tables.append(f"en AS (SELECT g, 0 AS start, count(*) AS n, {sums} FROM (SELECT g, {each('x{i} AS v{i}')} FROM near WHERE d2 <= {real(REWEIGHT)}) AS u GROUP BY g)")
    estimate("final", "en", CONSISTENT_REWEIGHTED)
    measured("far", "final")
    return rf"""
    WITH w AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    u AS (SELECT id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p, len(ws) AS n FROM w),
    k AS (SELECT id, p, p <= n - 4 AS starts, string_agg(word, ' ') OVER (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS key FROM u),
    f AS (SELECT id, p, starts AND count(*) OVER (PARTITION BY id, starts, key) > 1 AS again FROM k),
    c AS (SELECT id, bool_or(again) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM f),
    r AS (SELECT id, count_if(covered) AS n_repeat_words FROM c GROUP BY id),
    l AS (SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM w) AS v WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
    s AS MATERIALIZED (SELECT w.id, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(ws) AS base_failed
          FROM w LEFT JOIN r ON r.id = w.id LEFT JOIN l ON l.id = w.id),
    {(',' + chr(10) + '    ').join(tables)}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(d2 <= {CUTOFF}, false) AS kept FROM s LEFT JOIN far ON far.id = s.id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_ann": op4_ann,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sharding": op6_sharding,
    "op7_class_lm": op7_class_lm,
    "op8_packing": op8_packing,
    "op9_bpe": op9_bpe,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_quality_rules": op13_quality_rules,
}

SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op2_jaccard_join": OP2_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op6_sharding": op6_sql(),
    "op10_line_dedup": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_vector_codes": op12_sql(),
    "op13_quality_rules": op13_sql(),
}
