"""Queries of the training-data problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm.clusters import clusters, describe
from prismlake.llm.copies import copies, copy_groups
from prismlake.llm.languages import documents as document_languages
from prismlake.llm.languages import known, passages, train
from prismlake.llm.leaks import clean, leaks
from prismlake.llm.mixture import mix, plan, shares, token_counts
from prismlake.llm.neighbours import nearest
from prismlake.llm.sentences import sentences
from prismlake.llm.survivors import survivors, truths
from prismlake.llm.vectors import FACE_DIM, MEDIA_DIM, face_vectors, media_vectors
from prismlake.tables import cut, latest, table

VECTORS_SQL = """
media_now as (select mediaId as id, embedding, perceptualHash as hash, {more}
  from (select *, row_number() over (partition by mediaId order by sourceModified desc) as rn from media_analysis) where rn = 1),
media_vec as (select id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as nm
  from media_now where embedding is not null and len(embedding) = 96),
face_vec as (select id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as nm
  from (select distinct id, embedding, embedVersion, isArtifact from face)
  where embedVersion = 2 and not isArtifact and embedding is not null and len(embedding) = 128)
"""


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(table(spark, sf_dir, "media_analysis").select("mediaId", "sourceModified", "perceptualHash", "embedding"), "mediaId", "sourceModified")
    return rows.select(F.col("mediaId").alias("id"), F.col("perceptualHash").alias("hash"), F.col("embedding").alias("vec"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(_hashed(spark, sf_dir), MEDIA_DIM)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every media of a group of copies, its group, and its number of direct links."""
    return copy_groups(_hashed(spark, sf_dir), MEDIA_DIM)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(p1_groups(spark, sf_dir).select("media_id", "group_id"), "p2-groups")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    analysis = latest(table(spark, sf_dir, "media_analysis").select("mediaId", "sourceModified", "sharpness", "brightness", "qualityVersion"), "mediaId", "sourceModified")
    media = latest(table(spark, sf_dir, "media").select("id", "dateTaken", "dateModified", "size", "width", "height"), "id", "dateModified")
    return survivors(members, analysis, media)


def _claims(spark: SparkSession, sf_dir: str, members: DataFrame) -> DataFrame:
    """(subject, field, value, source, media_id): what each member of a group says; a value's source is the pass that measured it, or the kind of file."""
    analysis = latest(table(spark, sf_dir, "media_analysis").select("mediaId", "sourceModified", "sharpness", "brightness", "qualityVersion"), "mediaId", "sourceModified")
    media = latest(table(spark, sf_dir, "media").select("id", "dateTaken", "dateModified", "mimeType"), "id", "dateModified")
    rows = members.join(analysis.withColumnRenamed("mediaId", "media_id"), "media_id").join(media.withColumnRenamed("id", "media_id"), "media_id")
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0)
    measure = F.concat(F.lit("quality "), F.col("qualityVersion"))
    claim = lambda field, value, source, ok: F.when(ok, F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), source.alias("source")))
    return rows.select(F.col("group_id").alias("subject"), "media_id", F.explode(F.array_compact(F.array(
        claim("sharpness", F.round(F.log1p("sharpness"), 1), measure, known("sharpness") & (F.col("qualityVersion") > 0)),
        claim("brightness", F.round("brightness", 2), measure, known("brightness") & (F.col("brightness") <= 1) & (F.col("qualityVersion") > 0)),
        claim("dateTaken", F.to_date("dateTaken"), F.coalesce("mimeType", F.lit("none")), F.col("dateTaken") <= F.col("dateModified")),
    ))).alias("c")).select("subject", "media_id", "c.*")


def p2_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each group's fields with the belief that they are true."""
    found = truths(_claims(spark, sf_dir, _members(spark, sf_dir)).drop("media_id"))
    return found.select(F.col("subject").alias("group_id"), "field", "value", F.round("belief", 6).alias("belief"), "kept")


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By field: survivors of p2_found, those whose value the truth model keeps, and those whose value it believes in most."""
    claims = cut(_claims(spark, sf_dir, _members(spark, sf_dir)), "p2-claims")
    found = cut(truths(claims.drop("media_id")), "p2-truths")
    top = found.groupBy("subject", "field").agg(F.max("belief").alias("top"))
    kept = p2_found(spark, sf_dir).select(F.col("group_id").alias("subject"), "field", "media_id").join(claims.drop("source"), ["subject", "field", "media_id"])
    rated = kept.join(found, ["subject", "field", "value"]).join(top, ["subject", "field"])
    return rated.groupBy("field").agg(F.count("*").alias("survivors"), F.count(F.when(F.col("kept"), 1)).alias("kept"), F.count(F.when(F.col("belief") >= F.col("top") - 1e-9, 1)).alias("first"))


def _clusters(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    found = {}
    for kind, vectors, dim in (("media", media_vectors, MEDIA_DIM), ("face", face_vectors, FACE_DIM)):
        v = cut(vectors(spark, sf_dir), f"p4-{kind}")
        found[kind] = clusters(v, v.count(), dim)
    return found


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [c.select(F.lit(kind).alias("kind"), "cluster_id", "member_id") for kind, c in _clusters(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [describe(c).select(F.lit(kind).alias("kind"), "*") for kind, c in _clusters(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for kind, vectors, dim, least in (("media", media_vectors, MEDIA_DIM, 0.92), ("face", face_vectors, FACE_DIM, 0.70)):
        v = cut(vectors(spark, sf_dir), f"p6-{kind}")
        rows = nearest(v, v.count(), dim, 5, least).select(F.lit(kind).alias("kind"), "item_id", "neighbour_id")
        found = rows if found is None else found.unionByName(rows)
    return found


def p5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and place of every passage of every text line."""
    lines = latest(table(spark, sf_dir, "text_line").select("id", "mediaId", "text"), "id")
    labels = latest(table(spark, sf_dir, "text_label").select("mediaId", "lang"), "mediaId").select("mediaId", known("lang").alias("label"))
    lines = cut(lines.join(labels, "mediaId", "left"), "p5-lines")
    model = train(lines.select("id", "text", "label"))
    return passages(lines, model).select(F.col("mediaId").alias("media_id"), F.col("id").alias("line_id"), "label", "first", "past", "lang", "confidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_passages(spark, sf_dir).where("lang is not null and media_id is not null and (label is null or label <> lang)").select("media_id", "line_id", "lang").distinct()


def p5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of each media's text with its confidence, and the share of its letters in that language."""
    found = p5_passages(spark, sf_dir)
    return document_languages(found)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    name = F.lower(F.trim("source")).alias("source")
    targets = table(spark, sf_dir, "mix_target").select(name, "weight", "max_repeat")
    wanted = table(spark, sf_dir, "documents").select("doc_id", name, "text").join(targets.select("source").distinct(), "source", "left_semi")
    counts = cut(token_counts(wanted), "p8-counts")
    planned = plan(counts, targets)
    return mix(counts, planned), planned


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(*_mix(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents")).select("doc_id", "start_pos")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_truth": p2_truth, "p2_agreement": p2_agreement, "p4_found": p4_found, "p4_summary": p4_summary, "p5_found": p5_found, "p5_passages": p5_passages, "p5_documents": p5_documents, "p6_found": p6_found, "p7_found": p7_found, "p7_clean": p7_clean, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found}

PAIRS_SQL = VECTORS_SQL.format(more="sharpness, brightness, qualityVersion") + """,
good as (select * from media_vec where nm > 1e-12),
side as (select m.id, m.hash, bit_count(m.hash) as ones, g.v, g.nm from media_now m left join good g using (id)),
pair as (
  select a.id as media_a, b.id as media_b from side a join side b on a.id < b.id
  where a.hash is not null and b.hash is not null and bit_count(xor(a.hash, b.hash)) <= 6
    and case when a.nm is not null and b.nm is not null then list_dot_product(a.v, b.v) / a.nm / b.nm >= 0.95
        else bit_count(xor(a.hash, b.hash)) <= 3 and a.ones between 5 and 59 and b.ones between 5 and 59 end
  union all
  select least(a.id, b.id), greatest(a.id, b.id) from side a join side b
    on a.hash is null and a.nm is not null and b.nm is not null and (b.hash is not null or a.id < b.id)
  where list_dot_product(a.v, b.v) / a.nm / b.nm >= 0.98)
"""

GROUPS_SQL = PAIRS_SQL + """,
link as (select media_a as a, media_b as b from pair union select media_b, media_a from pair),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
member as (select a as media_id, least(a, min(b)) as group_id from reach group by a)
"""

ORACLE = {
    "p1_found": "with " + PAIRS_SQL + "select media_a, media_b from pair",
    "p1_groups": "with recursive " + GROUPS_SQL + "select media_id, group_id, (select count(*) from link where a = media_id) as links from member",
    "p2_found": "with recursive " + GROUPS_SQL + """,
media_row as (select * from (select *, row_number() over (partition by id order by dateModified desc) as rn from media) where rn = 1),
wide as (select g.group_id, g.media_id, n.sharpness, n.brightness, n.qualityVersion, m.dateTaken, m.dateModified,
    coalesce(m.width::bigint * m.height, -1) as px, coalesce(m.size, -1) as sz
  from member g left join media_now n on n.id = g.media_id left join media_row m on m.id = g.media_id),
ranked as (
  select group_id, 'sharpness' as field, media_id, row_number() over (partition by group_id order by qualityVersion desc, px desc, sz desc, media_id) as rn
  from wide where qualityVersion > 0 and sharpness is not null and not isnan(sharpness) and sharpness >= 0
  union all
  select group_id, 'brightness', media_id, row_number() over (partition by group_id order by qualityVersion desc, px desc, sz desc, media_id)
  from wide where qualityVersion > 0 and brightness is not null and not isnan(brightness) and brightness between 0 and 1
  union all
  select group_id, 'dateTaken', media_id, row_number() over (partition by group_id order by dateTaken, media_id)
  from wide where dateTaken >= timestamp '2000-01-01' and dateTaken <= dateModified)
select group_id, field, media_id from ranked where rn = 1
""",
    "p7_found": r"""
with doc as (select doc_id, regexp_extract_all(lower(regexp_replace(text, '[-\x{2010}][ \t]*\r?\n[ \t]*', '', 'g')), '[\p{L}\p{N}]+') as w from documents where text is not null),
item as (select item_id, regexp_extract_all(lower(regexp_replace(text, '[-\x{2010}][ \t]*\r?\n[ \t]*', '', 'g')), '[\p{L}\p{N}]+') as w from (select distinct item_id, text from eval_item)),
dg as (select doc_id, array_to_string(list_slice(w, i, i + 11), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from doc)),
ig as (select item_id, array_to_string(list_slice(w, i, i + 11), ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from item))
select distinct doc_id, item_id from dg join ig using (g)
""",
    "p4_found": "with recursive " + VECTORS_SQL.format(more="1 as one") + """,
v as (select 'media' as kind, id, v, nm from media_vec where nm > 1e-12 union all select 'face', id, v, nm from face_vec where nm > 1e-12),
edge as (select x.kind, x.id as a, y.id as b from v x join v y on x.kind = y.kind and x.id <> y.id where list_dot_product(x.v, y.v) / x.nm / y.nm >= 0.65),
reach(kind, a, b) as (select kind, a, b from edge union select r.kind, r.a, e.b from reach r join edge e on e.kind = r.kind and e.a = r.b),
part as (select kind, a as id, least(a, min(b)) as c from reach group by kind, a),
mean as (select x.kind, x.id, p.c, avg(list_dot_product(x.v, y.v) / x.nm / y.nm) as m from v x join part p on p.kind = x.kind and p.id <> x.id join v y on y.kind = p.kind and y.id = p.id group by x.kind, x.id, p.c),
best as (select * from (select *, row_number() over (partition by kind, id order by m desc, c) as rn from mean) where rn = 1 and m >= 0.57)
select kind, min(id) over (partition by kind, c) as cluster_id, id as member_id from best qualify count(*) over (partition by kind, c) >= 5
""",
    "p7_clean": r"""
with doc as (select doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[-\x{2010}][ \t]*\r?\n[ \t]*[\p{L}\p{N}]+)*') as w from documents where text is not null),
dw as (select doc_id, text, w, i, lower(regexp_replace(w[i], '[-\x{2010}][ \t]*\r?\n[ \t]*', '', 'g')) as plain from (select *, unnest(range(1, len(w) + 1)) as i from doc)),
item as (select item_id, regexp_extract_all(lower(regexp_replace(text, '[-\x{2010}][ \t]*\r?\n[ \t]*', '', 'g')), '[\p{L}\p{N}]+') as w from (select distinct item_id, text from eval_item)),
plain as (select doc_id, list(plain order by i) as p, any_value(text) as text, any_value(w) as w from dw group by doc_id),
dg as (select doc_id, i, array_to_string(list_slice(p, i, i + 11), ' ') as g from (select doc_id, p, unnest(range(1, len(p) - 10)) as i from plain)),
ig as (select distinct item_id, array_to_string(list_slice(w, i, i + 11), ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from item)),
hit as (select distinct doc_id, item_id, i from dg join ig using (g)),
run as (select *, sum(new) over (partition by doc_id, item_id order by i) as run from (select *, case when i - lag(i) over (partition by doc_id, item_id order by i) <= 12 then 0 else 1 end as new from hit)),
stretch as (select doc_id, item_id, min(i) as a, max(i) + 11 as b from run group by doc_id, item_id, run),
before as (select doc_id, text, w, split_part(text, chr(0), 1) as t from plain where doc_id in (select doc_id from hit)),
parts as (select doc_id, text, w, regexp_split_to_array(text, '[\p{L}\p{N}]+(?:[-\x{2010}][ \t]*\r?\n[ \t]*[\p{L}\p{N}]+)*') as s from before),
offs as (select doc_id, i, sum(len(s[i]) + case when i > 1 then len(w[i - 1]) else 0 end) over (partition by doc_id order by i) as start, len(w[i]) as size from (select doc_id, s, w, unnest(range(1, len(w) + 1)) as i from parts)),
placed as (select x.doc_id, x.item_id, f.start::bigint as first, (l.start + l.size)::bigint as past from stretch x join offs f on f.doc_id = x.doc_id and f.i = x.a join offs l on l.doc_id = x.doc_id and l.i = x.b),
step as (select distinct doc_id, first, past, max(past) over (partition by doc_id order by first, past rows between unbounded preceding and 1 preceding) as reach from placed),
isle as (select *, sum(case when reach is null or first > reach then 1 else 0 end) over (partition by doc_id order by first, past) as nth from step),
gone as (select doc_id, nth, min(first) as a, max(past) as b from isle group by 1, 2),
piece as (select doc_id, nth, a, b, coalesce(lag(b) over (partition by doc_id order by nth), 0) as prior from gone),
rest as (select p.doc_id, string_agg(substr(b.text, p.prior + 1, p.a - p.prior), '' order by nth) || substr(any_value(b.text), max(p.b) + 1) as kept from piece p join before b using (doc_id) group by p.doc_id)
select placed.*, rest.kept from placed join rest using (doc_id)
""",
    "p6_found": "with " + VECTORS_SQL.format(more="1 as one") + """, pairs as (
  select 'media' as kind, a.id as item_id, b.id as neighbour_id, round(list_dot_product(a.v, b.v) / a.nm / b.nm, 12) as c
  from media_vec a join media_vec b on a.id <> b.id where a.nm > 1e-12 and b.nm > 1e-12 and list_dot_product(a.v, b.v) / a.nm / b.nm >= 0.9199999
  union all
  select 'face', a.id, b.id, round(list_dot_product(a.v, b.v) / a.nm / b.nm, 12)
  from face_vec a join face_vec b on a.id <> b.id where a.nm > 1e-12 and b.nm > 1e-12 and list_dot_product(a.v, b.v) / a.nm / b.nm >= 0.6999999)
select kind, item_id, neighbour_id from (
  select *, row_number() over (partition by kind, item_id order by c desc, neighbour_id) as rn from pairs
  where c >= case kind when 'media' then 0.92 else 0.70 end) where rn <= 5
"""
}
