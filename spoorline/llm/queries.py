"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tables, decontaminate, langid, licenses, lines, minhash, periodic, pii, quality, subspace, token_counts, toxicity, whitening

BYTE_BPE = "byte_bpe_50k.json"
#: For SQL: text with A-Z in lower case, and the words in it.
_LOWERED = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, and whether it is kept, of every document: near copies by weighted signatures."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the pattern spans, and all spans."""
    docs = _table(spark, sf_dir, "documents")
    out = pii.personal_data(docs, pii.fit(docs))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans: str) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return out.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without boilerplate lines of many sites: counts, kept length and digest."""
    out = lines.remove_boilerplate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a field that learns from four fifths of the ids."""
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs))
    return out.select("doc_id", quality.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op5_subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, among vectors of its label."""
    return subspace.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, by a model that learns from two thirds of the ids."""
    docs = _table(spark, sf_dir, "documents")
    out = quality.quality_scores(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and sentences of every document."""
    out = licenses.license_hits(_table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["start"])

    def listed(hits: F.Column) -> F.Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")

    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows hold, and the items they come from."""
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    return bpe_tables.encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), digest=True)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document by clauses with insults or threats, learned from the labels outside a fifth of the ids."""
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest periodic run of each document, and digests of all its runs and of its words without repeats."""
    out = periodic.periodic_runs(_table(spark, sf_dir, "documents"), periodic.rewritten)
    best = F.array_sort("runs", lambda a, b: F.coalesce(*[F.when(x != y, F.when(x < y, -1).otherwise(1)) for x, y in ((b["length"], a["length"]), (a["start"], b["start"]), (a["period"], b["period"]))], F.lit(0)))
    out = out.withColumn("best", F.get(best, F.lit(0)))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.whitened(vectors, whitening.fit(vectors))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_minhash, op2_pii, op3_lines, op4_langid, op5_subspace, op6_token_counts, op7_quality, op8_licenses, op9_decontaminate, op10_bpe, op11_toxicity, op12_periodic, op13_whitening)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    lines_sql = f"""
        with parts as (
            select doc_id, source, unnest(string_split(text, chr(10))) as line,
                   generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
            from documents where text is not null
        ), full_lines as (select * from parts where trim(line) <> ''),
        wide as (select line from full_lines group by line having count(distinct source) >= {lines.MIN_SITES}),
        gone as (
            select doc_id, pos from (
                select doc_id, pos, row_number() over (partition by line order by doc_id, pos) as k
                from full_lines join wide using (line)
            ) where k > 1
        ), kept as (
            select p.doc_id, count(*) as n_lines, count(g.pos) as n_removed,
                   string_agg(p.line, chr(10) order by p.pos) filter (where g.pos is null) as body
            from parts p left join gone g on p.doc_id = g.doc_id and p.pos = g.pos group by p.doc_id
        )
        select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed,
               case when d.text is not null then length(coalesce(k.body, '')) end as n_kept_chars,
               case when d.text is not null then sha256(coalesce(k.body, '')) end as kept_sha256
        from documents d left join kept k using (doc_id)"""
    vectors_sql = f"""
        with recursive pair as materialized (
            select a.vec_id as u, b.vec_id as v from embeddings a join embeddings b
            on a.label = b.label and a.vec_id <> b.vec_id
            where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= {subspace.COSINE}
        ), reach as (
            select vec_id as u, vec_id as v from embeddings
            union
            select r.u, p.v from reach r join pair p on r.v = p.u
        ), low as (select u, min(v) as c from reach group by u),
        degree as (select u, count(*) as n from pair group by u)
        select e.vec_id, coalesce(d.n, 0) as n_links, l.c as component_id, e.vec_id = l.c as kept
        from embeddings e join low l on l.u = e.vec_id left join degree d on d.u = e.vec_id"""
    license_table = ", ".join(f"('{t.label}', {t.base}, {t.key}, {t.words}, {t.offset})" for t in licenses.TEMPLATES)
    licenses_sql = f"""
        with doc as (
            select doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') as w from documents
        ), template(label, base, phrase, body, off) as (values {license_table}),
        place as (
            select doc_id, w, label, base, body, off,
                   unnest([i for i in range(1, len(w) + 1) if w[i] = phrase[1] and w[i : i + len(phrase) - 1] = phrase]) as i
            from doc join template on list_has_all(w, phrase)
        ), hit as (
            select doc_id, label, base, i - 1 as start,
                   len([k for k in range(1, len(body) + 1) if i - off + k > 1 and w[i - off + k - 1] = body[k]]) / len(body)::double as share
            from place
        ), found as (
            select doc_id, count(*) filter (where base) as n, min(start) filter (where base) as lo, max(start) filter (where base) as hi,
                   string_agg(distinct label, ',' order by label) filter (where base) as base_labels,
                   string_agg(distinct label, ',' order by label) as labels, max(share) as score
            from hit group by doc_id
        )
        select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, lo::bigint as first_word, hi::bigint as last_word,
               coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
        from doc left join found using (doc_id)"""
    contamination_sql = f"""
        with doc as (
            select doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') as w from documents
        ), item as (
            select item_id::varchar as item_id, regexp_extract_all({_LOWERED}, '{_WORD}') as w from benchmark
        ), item_window as (
            select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as words from (
                select item_id, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i
                from item where len(w) > 0
            )
        ), doc_window as (
            select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as words from (
                select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i
                from doc join (select distinct k from item_window) on len(w) >= k
            )
        ), found as (
            select distinct doc_id, item_id, i, k from doc_window join item_window using (k, words)
        ), hit as (
            select doc_id, count(distinct place) as n from (
                select doc_id, unnest(range(i, i + k)) as place from (select distinct doc_id, i, k from found)
            ) group by doc_id
        ), items as (
            select doc_id, count(*) as n, string_agg(item_id, ',' order by item_id) as ids
            from (select distinct doc_id, item_id from found) group by doc_id
        )
        select doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit,
               coalesce(items.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
               coalesce(hit.n > 0 and 20 * hit.n >= len(w), false) as contaminated
        from doc left join hit using (doc_id) left join items using (doc_id)"""
    return {"op3_lines": lines_sql, "op5_subspace": vectors_sql, "op8_licenses": licenses_sql, "op9_decontaminate": contamination_sql}
