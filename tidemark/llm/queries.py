"""The registered queries of this subpackage: each applies one operator with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, html_text, langid, licenses, merkle, mixing, ngram_join, quality, sharding, token_align, token_index, toxicity
from tidemark.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.roundtrip(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), pct=85)


def op4_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=24)


def op5_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_viterbi_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "spans")


def op7_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_hypergeometric_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies", "shards"
    )


def op10_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.measure(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_index": op1_token_index,
    "op2_latent_decontamination": op2_latent_decontamination,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_hash_tree_sharding": op4_hash_tree_sharding,
    "op5_noisy_or_toxicity": op5_noisy_or_toxicity,
    "op6_viterbi_langid": op6_viterbi_langid,
    "op7_line_frequency_quality": op7_line_frequency_quality,
    "op8_patience_licenses": op8_patience_licenses,
    "op9_hypergeometric_mixing": op9_hypergeometric_mixing,
    "op10_consensus_html": op10_consensus_html,
    "op11_segment_tree_bpe": op11_segment_tree_bpe,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}
#: Components by brute force: shingles as text, overlaps by a join on them, and the transitive closure of the links.
OP3_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws)=0 THEN [] WHEN len(ws)<4 THEN [array_to_string(ws,' ')] ELSE list_transform(range(1,len(ws)-2), lambda i: array_to_string(ws[i:i+3],' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY 1,2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE 100*i>=85*(x.n+y.n-i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a=r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, component_id, CASE WHEN n.n=0 THEN n.doc_id ELSE min(n.doc_id) OVER (PARTITION BY n.h, n.n) END AS class_id FROM n JOIN c USING (doc_id)"""

#: Base measures by windows of words, and lines by their text.
OP7_SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(text,'') AS text, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(ws)-6, 1))) AS i, ws FROM d),
q AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i+7],' ')) AS c FROM p),
rep AS (SELECT doc_id, count(DISTINCT i+k) AS n FROM q, range(8) t(k) WHERE c>1 GROUP BY 1),
raw AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
li AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM raw),
good AS (SELECT *, length(norm)-length(replace(norm,' ',''))+1 AS n FROM li WHERE norm<>''),
dup AS (SELECT doc_id, count(*)-count(DISTINCT line) AS n FROM good GROUP BY 1),
host AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY 1),
often AS (SELECT g.source, norm FROM good g JOIN host h ON h.source IS NOT DISTINCT FROM g.source GROUP BY g.source, norm, texts HAVING count(DISTINCT text)>5 AND count(DISTINCT text)>0.05::DOUBLE*texts),
gone AS (SELECT g.doc_id, CAST(sum(n) AS BIGINT) AS n FROM good g JOIN often o ON o.source IS NOT DISTINCT FROM g.source AND o.norm=g.norm GROUP BY 1),
m AS (SELECT d.doc_id, len(ws) AS n_words, CAST(list_sum(list_concat([0], list_transform(ws, lambda x: length(x)))) AS BIGINT) AS word_chars, length(text)-length(translate(text,'#*$%&|<>','')) AS n_symbols, coalesce(dup.n,0) AS n_dup_lines, coalesce(rep.n,0) AS n_repeat_words, coalesce(gone.n,0) AS n_removed_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words<20 OR 100*n_repeat_words>30*n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (n_removed_words>0 AND (n_words-n_removed_words<20 OR n_words-n_removed_words<0.3::DOUBLE*n_words)) AS kept FROM f"""

#: Trees level by level; a leaf's siblings and the root that it folds to are followed up its own path.
OP13_SQL = r"""WITH RECURSIVE f AS (SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR)||':'||doc_id END||CASE WHEN source IS NULL THEN '-' ELSE strlen(source)||':'||source END||CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang)||':'||lang END AS a, CASE WHEN text IS NULL THEN '-' ELSE strlen(text)||':'||text END AS z FROM documents),
d AS (SELECT doc_id, lang, sha256(a||CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR)||':'||n_chars END||z) AS leaf, sha256(a||CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars+1)::VARCHAR)||':'||(n_chars+1) END||z) AS altered FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)-1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
lv AS (SELECT lang, 0 AS l, i, n, leaf AS h FROM p UNION ALL SELECT lang, l+1, i//2, (n+1)//2, sha256(string_agg(h,'' ORDER BY i)) FROM lv WHERE n>1 GROUP BY lang, l, i//2, n),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST)-1 AS i, count(*) OVER () AS n FROM lv WHERE n=1),
tv AS (SELECT 0 AS l, i, n, subroot AS h FROM s UNION ALL SELECT l+1, i//2, (n+1)//2, sha256(string_agg(h,'' ORDER BY i)) FROM tv WHERE n>1 GROUP BY l, i//2, n),
crc AS (SELECT range::BIGINT AS b, range::BIGINT AS c, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN c&1=1 THEN xor(c>>1, 3988292384) ELSE c>>1 END, k+1 FROM crc WHERE k<8),
tab AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE k=8),
c AS (SELECT p.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR,''), lambda x: ascii(x)::BIGINT)), lambda r, x: xor(r>>8, t[(xor(r,x)&255)+1])), 4294967295) AS crc FROM p, tab),
up AS (SELECT doc_id, leaf, lang, i, 0 AS l, '' AS proof, CASE WHEN crc%7=0 THEN altered ELSE leaf END AS h, i AS own FROM c
UNION ALL SELECT up.doc_id, leaf, up.lang, up.i, up.l+1, proof||coalesce(o.h,''), sha256(CASE WHEN own%2=1 THEN o.h||up.h ELSE up.h||coalesce(o.h,'') END), own//2 FROM up JOIN lv m ON m.lang IS NOT DISTINCT FROM up.lang AND m.l=up.l AND m.i=own AND m.n>1 LEFT JOIN lv o ON o.lang IS NOT DISTINCT FROM up.lang AND o.l=up.l AND o.i=xor(own,1)),
mid AS (SELECT up.*, s.subroot, s.i AS top FROM up JOIN s ON s.lang IS NOT DISTINCT FROM up.lang JOIN lv ON lv.lang IS NOT DISTINCT FROM up.lang AND lv.l=up.l AND lv.n=1),
upper AS (SELECT doc_id, leaf, lang, i, subroot, 0 AS l, proof, h, top AS own FROM mid
UNION ALL SELECT u.doc_id, leaf, lang, u.i, subroot, u.l+1, proof||coalesce(o.h,''), sha256(CASE WHEN own%2=1 THEN o.h||u.h ELSE u.h||coalesce(o.h,'') END), own//2 FROM upper u JOIN tv m ON m.l=u.l AND m.i=own AND m.n>1 LEFT JOIN tv o ON o.l=u.l AND o.i=xor(own,1))
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, u.h AS folded_root, u.h=r.h AS verified FROM upper u JOIN tv r ON r.n=1 AND r.l=u.l"""

ORACLES: dict[str, str] = {"op13_merkle_manifest": OP13_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op7_line_frequency_quality": OP7_SQL}
