"""Queries on diagram fingerprints, their likeness and plagiarism scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes as H
from ..functions.scale import shared_folder, written
from ..operators import diagrams as D
from ..operators import verdicts as V
from ..sources import catalogues as C
from . import bindings as B
from . import sql_text as S
from .oracle_views import with_views
from .registry import query


def _hex_sql(bits: str) -> str:
    """Array of booleans as hex digits."""
    return f"""list_aggregate(list_transform(range(0, cast(len({bits}) / 4 as bigint)), lambda q:
      lower(format('{{:x}}', cast(list_sum(list_transform([0, 1, 2, 3], lambda b:
        case when ({bits})[q * 4 + b + 1] then (8 >> b) else 0 end)) as bigint)))), 'string_agg', '')"""


FINGERPRINTS_SQL = f"""select image_id, {_hex_sql('pb')} as phash, {_hex_sql('ab')} as ahash, {_hex_sql('db')} as dhash from (
  select vec_id as image_id,
    list_transform(v, lambda x: x > list_median(v)) as pb,
    list_transform(v, lambda x: x > list_reduce(v, lambda s, y: s + y) / len(v)) as ab,
    list_transform(list_filter(range(1, len(v) + 1), lambda i: (i - 1) % 8 <> 0), lambda i: v[i] > v[i - 1]) as db
  from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings))"""


def grid_rows(values, width: int = 8):
    """A flat array as rows of ``width`` values."""
    starts = F.sequence(F.lit(1), F.size(values), F.lit(width))
    return F.transform(starts, lambda i: F.slice(values, i, F.lit(width)))


@query("f11_fingerprints", FINGERPRINTS_SQL)
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    values = F.col("embedding")
    # A row of 8 gives 7 comparisons, 56 bits over 8 rows.
    return B.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        H.phash(values).alias("phash"),
        H.ahash(values).alias("ahash"),
        H.dhash(grid_rows(values)).alias("dhash"),
    )


@query(
    "f9_f10_hash_distances",
    with_views(
        ["diagrams_v"],
        """select a.diagram_id, list_sum(list_transform(range(1, 17), lambda i: case when a.hash[i] <> b.hash[i] then 1 else 0 end))::bigint
             as hex_distance, bit_count(xor(('0x' || a.hash)::ubigint, ('0x' || b.hash)::ubigint))::bigint as bit_distance
        from diagrams_v a join diagrams_v b on b.diagram_id = a.diagram_id + 1""",
    ),
)
def hash_distances(spark: SparkSession, folder: str) -> DataFrame:
    d = B.diagrams_v(spark, folder)
    after = d.select((F.col("diagram_id") - 1).alias("diagram_id"), F.col("hash").alias("next"))
    return d.join(after, "diagram_id").select(
        "diagram_id",
        H.hex_distance(F.col("hash"), F.col("next")).cast("bigint").alias("hex_distance"),
        H.bit_distance(F.col("hash"), F.col("next"), 16).cast("bigint").alias("bit_distance"),
    )


HEX = "list_sum(list_transform(range(1, 17), lambda i: case when a.hash[i] <> b.hash[i] then 1 else 0 end))::bigint"


@query(
    "j16_suspicious_diagrams",
    with_views(
        ["diagrams_v"],
        f"""select a.diagram_id, a.paper_id, b.diagram_id as matched_diagram_id, 1 - {HEX} / 64.0::double as similarity_score
        from diagrams_v a join diagrams_v b on a.paper_id <> b.paper_id
        where 1 - {HEX} / 64.0::double > 0.85
        qualify row_number() over (partition by a.diagram_id order by b.diagram_id) = 1""",
    ),
)
def suspicious_diagrams(spark: SparkSession, folder: str) -> DataFrame:
    return D.suspicious_diagrams(B.diagrams_v(spark, folder))


@query(
    "j18_hashes_within",
    with_views(
        ["diagrams_v"],
        f"""select distinct a.hash, b.hash as other, {HEX} as distance from diagrams_v a join diagrams_v b on a.hash < b.hash
        where {HEX} <= 5""",
    ),
)
def hashes_within(spark: SparkSession, folder: str) -> DataFrame:
    near = D.hashes_within(B.diagrams_v(spark, folder))
    return near.withColumn("distance", F.col("distance").cast("bigint"))


def _bits_sql(digits: int) -> str:
    words = [f"bit_count(xor(('0x' || a.hash[{i + 1}:{i + 16}])::ubigint, ('0x' || b.hash[{i + 1}:{i + 16}])::ubigint))::int" for i in range(0, digits, 16)]
    return f"({' + '.join(words)})"


def _flags_sql(larger: str) -> str:
    """Hex digits of 64 flags; ``larger`` is the flag of place ``i``, counted from 1, in the list ``v``."""
    return f"""list_aggregate(list_transform(range(0, 16), lambda q: lower(format('{{:x}}', list_sum(list_transform([1, 2, 3, 4],
      lambda b: case when {larger.replace('@', '(q * 4 + b)')} then (16 >> b) else 0 end))::bigint))), 'string_agg', '')"""


#: 256 bits of a vector: larger than the median, than the value before, and both for absolute values.
WIDE_SQL = f"""select vec_id, {_flags_sql('v[@] > m')} || {_flags_sql('v[@ % 64 + 1] > v[@]')} || {_flags_sql('w[@] > n')}
    || {_flags_sql('w[@ % 64 + 1] > w[@]')} as hash
  from (select vec_id, v, w, list_median(v) as m, list_median(w) as n from (
    select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v,
      list_transform(embedding, lambda x: abs(cast(x as double))) as w from embeddings))"""
LIKENESS_SQL = f"1 - {_bits_sql(64)} / 256.0::double"
STORE = [
    ("wide", WIDE_SQL),
    ("store", "select concat('d/', cast(vec_id as varchar)) as file_path, hash from wide"),
    (
        "matches",
        f"""select a.file_path as query_path, b.file_path, {LIKENESS_SQL} as similarity from store a
            join store b on a.file_path <> b.file_path where {LIKENESS_SQL} >= 0.8""",
    ),
]


def hash_store(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of 256 bits, see ``WIDE_SQL``."""
    values = F.col("embedding").cast("array<double>")
    parts = []
    for v in (values, F.transform(values, F.abs)):
        parts += [H.phash(v), H.dhash(F.array(F.concat(v, F.slice(v, 1, 1))))]
    vectors = B.table(spark, folder, "embeddings")
    return vectors.select(F.concat(F.lit("d/"), F.col("vec_id").cast("string")).alias("file_path"), F.concat(*parts).alias("hash"))


@query(
    "j17_find_similar_hashes",
    with_views(
        [],
        f"""select a.hash, b.hash as other, {LIKENESS_SQL} as similarity, b.n_files from (select distinct hash from store) a
        join (select hash, count(*) as n_files from store group by hash) b on {LIKENESS_SQL} >= 0.8""",
        *STORE[:2],
    ),
)
def find_similar_hashes(spark: SparkSession, folder: str) -> DataFrame:
    store = hash_store(spark, folder)
    return D.find_similar_hashes(store, store)


@query(
    "a12_hash_match_summary",
    with_views(
        [],
        """select query_path, count(*) as n_matches, max(similarity) as highest,
             array_to_string(list(file_path order by similarity desc, file_path)[:5], ',') as top_paths
           from matches group by query_path""",
        *STORE,
    ),
)
def hash_match_summary(spark: SparkSession, folder: str) -> DataFrame:
    store = hash_store(spark, folder)
    found = D.hash_match_summary(store, store)
    return found.withColumn("top_paths", F.array_join("top_paths", ","))


@query(
    "a1_duplicate_groups",
    with_views(
        ["images_v"],
        "select hash, count(*) as n_files from images_v where hash <> '' group by hash having count(*) > 1",
    ),
)
def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    return D.duplicate_groups(B.images_v(spark, folder))


@query(
    "a1_duplicate_files",
    with_views(
        ["images_v"],
        """select hash, image_id, filename, n_files from (select *, count(*) over (partition by hash) as n_files from images_v
           where hash <> '') where n_files > 1""",
    ),
)
def duplicate_files(spark: SparkSession, folder: str) -> DataFrame:
    return D.duplicate_files(B.images_v(spark, folder))


@query(
    "a1_duplicate_summary",
    with_views(
        ["images_v"],
        """select job_id, sum(n)::bigint as total_images, sum(case when hash = '' then n else 1 end)::bigint as unique_images
           from (select job_id, hash, count(*) as n from images_v group by 1, 2) group by job_id""",
    ),
)
def duplicate_summary(spark: SparkSession, folder: str) -> DataFrame:
    return D.duplicate_summary(B.images_v(spark, folder), ["job_id"])


@query(
    "j23_w6_mark_duplicates",
    with_views(
        ["images_v"],
        """select image_id, hash <> '' and n > 1 as is_duplicate, case when hash <> '' then n else 1 end as n_files
           from (select *, count(*) over (partition by hash) as n from images_v)""",
    ),
)
def mark_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    marked = D.mark_duplicates(B.images_v(spark, folder))
    return marked.select("image_id", "is_duplicate", F.col("n_files").cast("bigint").alias("n_files"))


DESCRIPTORS_SQL = "select vec_id // 20 as pair_id, vec_id as desc_id, hash from (select diagram_id as vec_id, hash from diagrams_v)"
NEAREST_SQL = """select a.pair_id, a.desc_id, bit_count(xor(('0x' || a.hash)::ubigint, ('0x' || b.hash)::ubigint)) as d,
    row_number() over (partition by a.desc_id order by bit_count(xor(('0x' || a.hash)::ubigint, ('0x' || b.hash)::ubigint)), b.desc_id) as r
  from descriptors a join descriptors b on b.pair_id = a.pair_id and a.desc_id % 2 = 0 and b.desc_id % 2 = 1"""


@query(
    "j19_descriptor_match",
    with_views(
        ["diagrams_v"],
        """select pair_id, count(*) filter (n = 2 and d1 < 0.75 * d2) as good, count(*) as n_descriptors,
             count(*) filter (n = 2 and d1 < 0.75 * d2) / count(*)::double as orb_score
           from (select pair_id, desc_id, min(d) as d1, max(d) as d2, count(*) as n from nearest where r <= 2 group by 1, 2)
           group by pair_id""",
        ("descriptors", DESCRIPTORS_SQL),
        ("nearest", NEAREST_SQL),
    ),
)
def descriptor_match(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty neighbouring vectors are one image pair: even ids the query, odd ids the train side."""
    rows = B.diagrams_v(spark, folder).select(
        F.expr("diagram_id div 20").alias("pair_id"),
        F.col("diagram_id").alias("desc_id"),
        F.array(*H.hash_words(F.col("hash"), 16)).alias("bits"),
    )
    return D.descriptor_match(rows.where("desc_id % 2 = 0"), rows.where("desc_id % 2 = 1"))


@query(
    "j20_compare_with_reference_set",
    """select image_id, count(*) as total_compared, count(*) filter (score >= 35) as n_matches,
         arg_max(ref_id, {'s': score, 'r': -ref_id, 'm': ssim}) filter (score >= 35) as best_ref,
         coalesce(max(score) filter (score >= 35), 0.0) as best_score,
         arg_max(ssim, {'s': score, 'r': -ref_id, 'm': ssim}) filter (score >= 35) as best_ssim
       from (select l_orderkey as image_id, l_linenumber as ref_id, l_discount * 10 as orb_score, l_tax * 10 as ssim,
               (l_discount * 10 * 0.4 + l_tax * 10 * 0.6) * 100 as score from lineitem) group by image_id""",
)
def compare_with_reference_set(spark: SparkSession, folder: str) -> DataFrame:
    pairs = B.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey as image_id", "l_linenumber as ref_id", "l_discount * 10 as orb_score", "l_tax * 10 as ssim"
    )
    return D.compare_with_reference_set(pairs)


@query(
    "p12_is_likely_copied",
    """select l_orderkey as image_id, l_linenumber as ref_id, count(*) as n,
         l_discount * 10 > 0.35 or l_tax * 10 > 0.65 as likely_copied,
         case when l_discount * 10 > 0.35 then 'ORB matches > 35%' when l_tax * 10 > 0.65 then 'SSIM > 0.65'
           else 'Below thresholds' end as reason from lineitem group by all""",
)
def is_likely_copied(spark: SparkSession, folder: str) -> DataFrame:
    pairs = B.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey as image_id", "l_linenumber as ref_id", "l_discount * 10 as orb_score", "l_tax * 10 as ssim"
    )
    copied = V.is_likely_copied(pairs)
    return copied.groupBy("image_id", "ref_id", "likely_copied", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a14_ssim",
    """select pair_id, avg(((2 * mp * mq + c1) * (2 * cov + c2)) / ((mp * mp + mq * mq + c1) * (vp + vq + c2))) as ssim from (
         select pair_id, wy, wx, avg(p) as mp, avg(q) as mq, var_samp(p) as vp, var_samp(q) as vq, covar_samp(p, q) as cov,
           (0.01 * 2.0)::double ** 2 as c1, (0.03 * 2.0)::double ** 2 as c2 from (
             select a.vec_id // 2 as pair_id, (i - 1) // 8 - dy as wy, (i - 1) % 8 - dx as wx,
               a.embedding[i]::double as p, b.embedding[i]::double as q
             from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 and a.vec_id % 2 = 0,
               range(1, 65) r(i), range(0, 7) ry(dy), range(0, 7) rx(dx))
         group by 1, 2, 3 having count(*) = 49) group by pair_id""",
)
def ssim(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors 2n and 2n+1 as 8x8 images with values between -1 and 1."""
    pixels = B.table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).selectExpr(
        "vec_id div 2 as pair_id", "vec_id % 2 as side", "cast(i div 8 as int) as y", "cast(i % 8 as int) as x", "v"
    )
    return D.ssim(pixels.where("side = 0"), pixels.where("side = 1"), ["pair_id"], data_range=2.0)


SCORED_SQL = (
    "scored",
    f"""select *, case when confidence >= 0.7 then 'heavily plagiarized' when confidence >= 0.4 then 'partially plagiarized'
           else 'original' end as decision from (
         select *, case when hash_sim > 0.9 then 0.3::double else 0.0 end + case when ssim > 0.75 then 0.4::double else 0.0 end
             + case when best_match_pct / 100 > 0.35 then 0.2::double else 0.0 end
             + case when web_found then 0.3::double else 0.0 end as confidence,
           {S.notes(
             "case when hash_sim > 0.9 then 'Strong hash match detected' end",
             "case when ssim > 0.75 then printf('High SSIM similarity: %.2f', ssim) end",
             "case when best_match_pct / 100 > 0.35 then printf('ORB match percentage: %.2f%%', best_match_pct) end",
             "case when web_found then 'Visually similar images found on Google' end")} as indicators
         from evidence_v)""",
)


@query(
    "p11_score_diagram",
    with_views(["evidence_v"], "select job_id, image_id, confidence, indicators, decision from scored", SCORED_SQL),
)
def score_diagram(spark: SparkSession, folder: str) -> DataFrame:
    scored = V.score_diagram(B.evidence_v(spark, folder))
    return scored.select("job_id", "image_id", "confidence", F.array_join("indicators", "; ").alias("indicators"), "decision")


@query(
    "a8_plagiarism_summary",
    with_views(
        ["evidence_v"],
        """select *, case when heavily_plagiarized > 0 or partially_plagiarized > total * 0.5 then 'high'
             when partially_plagiarized > 0 then 'medium' else 'low' end as risk_level from (
           select job_id, count(*) as total, count(*) filter (decision = 'original') as original,
             count(*) filter (decision = 'partially plagiarized') as partially_plagiarized,
             count(*) filter (decision = 'heavily plagiarized') as heavily_plagiarized,
             avg(confidence) as average_confidence from scored group by job_id)""",
        SCORED_SQL,
    ),
)
def plagiarism_summary(spark: SparkSession, folder: str) -> DataFrame:
    return V.plagiarism_summary(V.score_diagram(B.evidence_v(spark, folder)))


@query(
    "p22_web_suspicion",
    with_views(
        ["diagrams_v"],
        f"""select d.diagram_id, coalesce(w.n, 0)::bigint as n_matches, greatest(l.similarity_score, w.s) as similarity_score,
             l.similarity_score is not null or w.n is not null as is_suspicious
           from diagrams_v d left join (
             select a.diagram_id, 1 - {HEX} / 64.0::double as similarity_score
             from diagrams_v a join diagrams_v b on a.paper_id <> b.paper_id where 1 - {HEX} / 64.0::double > 0.85
             qualify row_number() over (partition by a.diagram_id order by b.diagram_id) = 1) l on l.diagram_id = d.diagram_id
           left join (select page_id % 37 as diagram_id, count(*) as n, least(count(*) / 10.0::double, 1.0::double) as s
             from pages group by 1) w on w.diagram_id = d.diagram_id""",
    ),
)
def web_suspicion(spark: SparkSession, folder: str) -> DataFrame:
    diagrams = B.diagrams_v(spark, folder)
    near = D.suspicious_diagrams(diagrams).select("diagram_id", "similarity_score")
    local = diagrams.select("diagram_id").join(near, "diagram_id", "left").withColumn(
        "is_suspicious", F.col("similarity_score").isNotNull()
    )
    matches = B.table(spark, folder, "pages").selectExpr("page_id % 37 as diagram_id", "url")
    found = V.web_suspicion(matches, local)
    return found.withColumn("n_matches", F.col("n_matches").cast("bigint"))


@query(
    "s12_report_round_trip",
    with_views(
        ["evidence_v"],
        """select s.job_id::varchar as job_id, s.image_id, concat('d/', s.job_id, '_', s.image_id, '.png') as diagram, best_match_pct as score,
             s.decision, s.confidence, s.indicators, t.total, t.heavy, case when heavy > 0 or partial > total * 0.5 then 'high'
             when partial > 0 then 'medium' else 'low' end as risk_level
           from scored s join (select job_id, count(*) as total, count(*) filter (decision = 'partially plagiarized') as partial,
               count(*) filter (decision = 'heavily plagiarized') as heavy from scored group by job_id) t using (job_id)""",
        SCORED_SQL,
    ),
)
def report_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The reports of all jobs written as nested JSON and read back, one row for each diagram."""
    scored = written(V.score_diagram(B.evidence_v(spark, folder)))
    scored = scored.withColumn("diagram", F.concat(F.lit("d/"), "job_id", F.lit("_"), "image_id", F.lit(".png")))
    path = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    C.write_report(scored, V.plagiarism_summary(scored), path, compression="gzip")
    found = C.report_diagrams(C.read_report(spark.read.text(path).select("value")))
    return found.select(
        "job_id",
        F.col("index").alias("image_id"),
        "diagram",
        F.col("localSimilarity.bestMatch.score").alias("score"),
        "decision",
        "confidence",
        F.array_join("indicators", "; ").alias("indicators"),
        F.col("totalDiagrams").cast("bigint").alias("total"),
        F.col("summary.heavilyPlagiarized").cast("bigint").alias("heavy"),
        F.col("summary.riskLevel").alias("risk_level"),
    )
