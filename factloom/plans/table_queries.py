"""Registered queries on documents, proposals, graphs, questions and metrics, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import ontology
from factloom.functions import text as T
from factloom.operators import documents as D
from factloom.operators import extraction as X
from factloom.operators import graph as G
from factloom.operators import metrics as M
from factloom.operators import qa as Q
from factloom.operators import similarity as S
from factloom.plans import stargraph
from factloom.plans.stargraph import table
from factloom.sources import documents as files
from factloom.sources import stages, store
from factloom.sources.versions import GraphFiles

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---- documents


@query("SELECT source, sum(strlen(text) + 1)::BIGINT AS bytes, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents WHERE text IS NOT NULL GROUP BY source")
def s1_document_set(spark, sf_dir):
    """The texts as lines of text files in a folder for each source, read back as a set of document files."""
    folder = stages.shared_folder(spark, "files")
    docs(spark, sf_dir).where("text IS NOT NULL").select("source", "text").write.partitionBy("source").text(folder)
    rows = files.read_files(spark, folder).withColumn("of", F.regexp_extract("source", "source=([^/]*)/", 1))
    return rows.groupBy(F.col("of").alias("source")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.regexp_count("text", F.lit("\n"))).alias("lines"))


@query("SELECT doc_id, length(regexp_replace(text, '^' || chr(65279), '')) AS chars FROM documents WHERE text IS NOT NULL")
def s2_decode_text(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.length(files.decoded(F.encode("text", "UTF-8"))).cast("long").alias("chars"))


@query("SELECT substr(sha256(text), 1, 20) AS content, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def s4_content_ids(spark, sf_dir):
    rows = docs(spark, sf_dir).where("text IS NOT NULL").withColumn("content", T.content_id(F.col("text").cast("binary")))
    return rows.groupBy("content").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("""
WITH f AS (SELECT source AS batch, doc_id AS pos, doc_id || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.pdf' WHEN 3 THEN '.docx' ELSE '.exe' END AS name, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents),
g AS (SELECT *, CASE WHEN pos % 5 = 4 THEN 'unsupported' WHEN bytes <= 0 THEN 'empty' WHEN bytes > 20000 THEN 'too large' END AS alone FROM f),
h AS (SELECT *, sum((alone IS NULL)::INT) OVER w AS n, sum(CASE WHEN alone IS NULL THEN bytes ELSE 0 END) OVER w AS total FROM g WINDOW w AS (PARTITION BY batch ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT batch, pos, coalesce(alone, CASE WHEN n > 200 THEN 'too many' WHEN total > 60000 THEN 'too much' END) AS reason FROM h
""")
def s5_admission(spark, sf_dir):
    """Documents as the files of one upload for each source, under small limits."""
    suffix = F.element_at(F.array(*map(F.lit, (".txt", ".MD", ".pdf", ".docx", ".exe"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = docs(spark, sf_dir).select(F.col("source").alias("batch"), F.col("doc_id").alias("pos"), F.concat("doc_id", suffix).alias("name"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return files.admit(rows, max_file=20_000, max_files=200, max_total=60_000).select("batch", "pos", "reason")


@query("""
SELECT doc_id, sha256(regexp_replace(trim(regexp_replace(replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(12288), ' '), '\\s+', ' ', 'g')), '(^|[^A-Za-z])([A-Z]{1,4}) +([0-9])', '\\1\\2\\3', 'g')) AS cleaned
FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '\\n[ \\t]*\\n')
""")
def d1_preprocess(spark, sf_dir):
    """Texts, cleaned paragraph by paragraph; the SQL has those of one paragraph, which those of sf0.001 and sf0.01 are."""
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.sha2(T.preprocess(F.col("text")).cast("binary"), 256).alias("cleaned"))


@query()
def d2_chunks(spark, sf_dir):
    return D.chunks(docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


@query("SELECT printf('%s:%s:%04d', substr(sha256(text), 1, 20), source, 0) AS chunk_id, doc_id FROM documents WHERE text IS NOT NULL")
def d4_chunk_ids(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL").select(T.chunk_id(T.content_id(F.col("text").cast("binary")), F.col("source"), F.lit(0)).alias("chunk_id"), "doc_id")


@query("""
SELECT doc AS doc_id, arg_max(source, doc_id) AS source, arg_max(source, doc_id) AS name FROM (SELECT 'd' || (doc_id % 50) AS doc, doc_id, source FROM documents) GROUP BY doc
""")
def d5_document_rows(spark, sf_dir):
    doc = F.concat(F.lit("d"), F.col("doc_id") % 50)
    return D.document_rows(docs(spark, sf_dir).select(F.concat_ws(":", doc, "source", F.col("doc_id").cast("string")).alias("chunk_id"), "source", "doc_id"), "doc_id")


# ---- proposals: the capitalised words of each document, with types and confidences drawn by md5

_MENTIONS = """
words AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+')) AS name, unnest(range(0, len(regexp_extract_all(text, '\\b[A-Z][a-z]+')))) AS pos FROM documents WHERE text IS NOT NULL),
mentions AS (
  SELECT doc_id AS chunk_id, pos, name, CASE ('0x' || substr(md5(name), 1, 4))::INT % 4 WHEN 0 THEN 'Weapon System' WHEN 1 THEN 'Combat Unit' WHEN 2 THEN 'Platform/Carrier' ELSE 'Vehicle' END AS type,
         (('0x' || substr(md5(doc_id || '|' || pos), 1, 6))::INT % 100) / 100::DOUBLE AS confidence FROM words
)
"""


def drawn(text, digits: int, modulus: int):
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long") % modulus


def mentions(spark, sf_dir) -> DataFrame:
    words = docs(spark, sf_dir).where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), F.posexplode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+"), 0)).alias("pos", "name"))
    return words.select("chunk_id", F.col("pos").cast("long").alias("pos"), "name", *mention_drawn(F.col("chunk_id"), F.col("pos"), F.col("name")))


def mention_drawn(chunk_id, pos, name) -> list:
    """type and confidence of a mention"""
    kinds = F.array(*map(F.lit, ("Weapon System", "Combat Unit", "Platform/Carrier", "Vehicle")))
    return [F.element_at(kinds, (drawn(name, 4, 4) + 1).cast("int")).alias("type"), (drawn(F.concat_ws("|", chunk_id, pos), 6, 100) / 100).alias("confidence")]


def misspelt(c, pos=None):
    """Every seventh name, as the text does not have it."""
    return F.when((F.col("pos") if pos is None else pos) % 7 == 0, F.concat(c, F.lit("zzqx"))).otherwise(c)


@query(f"""WITH {_MENTIONS}, judged AS (SELECT chunk_id, CASE WHEN pos % 7 = 0 THEN 'name_not_in_source' WHEN type = 'Vehicle' THEN 'unknown_type' WHEN confidence < 0.2 THEN 'low_confidence' ELSE 'kept' END AS reason FROM mentions)
SELECT chunk_id, count(*) FILTER (WHERE reason = 'name_not_in_source') AS name_not_in_source, count(*) FILTER (WHERE reason = 'unknown_type') AS unknown_type, count(*) FILTER (WHERE reason = 'low_confidence') AS low_confidence,
  count(*) FILTER (WHERE reason = 'kept') AS kept FROM judged GROUP BY chunk_id""")
def x4_entity_filters(spark, sf_dir):
    """The capitalised words of each document, some of them misspelt, looked up in its text."""
    item = F.struct("pos", F.lit(False).alias("bad"), misspelt(F.col("name")).alias("name"), "type", F.array().cast("array<string>").alias("aliases"), F.create_map().cast("map<string,string>").alias("attributes"), F.col("confidence").cast("string").alias("confidence"))
    lists = mentions(spark, sf_dir).groupBy("chunk_id").agg(F.collect_list(item).alias("entities"))
    found = X.locate(lists, docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), entities="name")
    rows = X.check_entities(found.select("chunk_id", F.inline("entities")), ontology.entity_types(spark), min_confidence=0.2)
    return rows.groupBy("chunk_id").agg(*[F.count_if(F.coalesce("reason", F.lit("kept")) == r).alias(r) for r in ("name_not_in_source", "unknown_type", "low_confidence", "kept")])


@query(f"""WITH {_MENTIONS}, w AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, name ORDER BY confidence DESC, pos) = 1 AS kept, min(pos) OVER (PARTITION BY chunk_id, name) AS first_pos,
  coalesce(max(confidence) OVER (PARTITION BY chunk_id, name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= confidence, false) AS duplicate FROM mentions)
SELECT chunk_id, count(*) FILTER (WHERE kept) AS names, sum(CASE WHEN kept THEN confidence END) AS sure, sum(CASE WHEN kept THEN first_pos END)::BIGINT AS places, count(*) FILTER (WHERE duplicate) AS duplicates FROM w GROUP BY chunk_id""")
def x5_entity_dedup(spark, sf_dir):
    rows = X.dedup_entities(mentions(spark, sf_dir))
    kept = lambda c: F.sum(F.when(F.col("kept"), F.col(c)))
    return rows.groupBy("chunk_id").agg(F.count_if("kept").alias("names"), kept("confidence").alias("sure"), kept("first_pos").alias("places"), F.count_if("duplicate").alias("duplicates"))


@query("""SELECT coerced, count(*) AS n FROM (SELECT CASE WHEN given IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, coalesce(try_cast(given AS DOUBLE), 0.0))) END::DOUBLE AS coerced
  FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'high' WHEN 2 THEN (l_quantity / 40)::VARCHAR ELSE (l_discount - 0.05)::VARCHAR END AS given FROM lineitem)) GROUP BY 1""")
def x6_confidence_coercion(spark, sf_dir):
    given = F.when(F.col("l_linenumber") % 4 == 0, F.lit(None)).when(F.col("l_linenumber") % 4 == 1, "high").when(F.col("l_linenumber") % 4 == 2, (F.col("l_quantity") / 40).cast("string")).otherwise((F.col("l_discount") - 0.05).cast("string"))
    return table(spark, sf_dir, "lineitem").select(T.confidence(given).alias("coerced")).groupBy("coerced").agg(F.count("*").alias("n"))


@query(f"WITH {_MENTIONS} SELECT chunk_id, key, min(name) AS name FROM (SELECT chunk_id, lower(name) AS key, name FROM mentions UNION ALL SELECT chunk_id, lower(substr(name, 1, 3)), name FROM mentions) GROUP BY 1, 2 HAVING count(DISTINCT name) = 1")
def x7_endpoint_resolution(spark, sf_dir):
    return X.endpoint_keys(mentions(spark, sf_dir).withColumn("aliases", F.array(F.substring("name", 1, 3))))


@query(f"""WITH {stargraph.SQL}, both_ways AS (SELECT type, source_type, target_type FROM edges UNION ALL SELECT type, target_type, source_type FROM edges)
SELECT type, source_type, target_type, count(*) AS n FROM both_ways WHERE (type, source_type, target_type) IN (
  ('Equip-Carry', 'Platform/Carrier', 'Weapon System'), ('Unit-Equip', 'Combat Unit', 'Weapon System'), ('Unit-Org', 'Combat Unit', 'Command Structure'), ('Weapon-Spec', 'Weapon System', 'Technical Specification'),
  ('Equip-Counter', 'Weapon System', 'Weapon System'), ('Campaign-Part', 'Campaign/Operation', 'Combat Unit'), ('Causal-Lead', 'Campaign/Operation', 'Campaign/Operation')) GROUP BY 1, 2, 3""")
def x8_ontology_check(spark, sf_dir):
    """Edges both as they are and turned round; the turned ones mostly break the rules."""
    e = stargraph.edges(spark, sf_dir).select("type", "source_type", "target_type")
    both = e.unionByName(e.select("type", F.col("target_type").alias("source_type"), F.col("source_type").alias("target_type")))
    return X.ontology_check(both, ontology.relation_rules(spark)).groupBy("type", "source_type", "target_type").agg(F.count("*").alias("n"))


_PAIRS = f"{_MENTIONS}, pairs AS (SELECT a.chunk_id, a.pos, a.name AS source, b.name AS target, 'Equip-Counter' AS type, a.name || ' ' || b.name AS evidence FROM mentions a JOIN mentions b ON a.chunk_id = b.chunk_id AND b.pos = a.pos + 1)"


def neighbours(spark, sf_dir) -> DataFrame:
    """Relations between neighbouring mentions of a document."""
    m = mentions(spark, sf_dir)
    after = W.partitionBy("chunk_id").orderBy("pos")
    rows = m.select("chunk_id", "pos", F.col("name").alias("source"), F.lead("name").over(after).alias("target"), F.lit("Equip-Counter").alias("type")).where("target IS NOT NULL")
    return rows.withColumn("evidence", F.concat_ws(" ", "source", "target"))


@query(f"""WITH {_PAIRS}, told AS (SELECT p.*, ['Equip-Counter', 'Unit-Equip', 'Equip-Develop'][(pos % 3)::INT + 1] AS kind, ['designed', 'intercepts', 'met'][(('0x' || substr(md5(p.source), 1, 4))::INT % 3) + 1] AS verb,
    (SELECT any_value(type) FROM mentions m WHERE m.name = p.source) AS st, (SELECT any_value(type) FROM mentions m WHERE m.name = p.target) AS tt FROM pairs p),
judged AS (SELECT kind AS type, CASE
  WHEN NOT ((kind = 'Equip-Counter' AND st = 'Weapon System' AND tt = 'Weapon System') OR (kind = 'Unit-Equip' AND st = 'Combat Unit' AND tt IN ('Weapon System', 'Platform/Carrier')) OR (kind = 'Equip-Develop' AND st IN ('Weapon System', 'Platform/Carrier') AND tt = 'Combat Unit')) THEN 'invalid_type_or_direction'
  WHEN kind = 'Equip-Develop' AND verb <> 'designed' THEN 'no_development_statement' WHEN kind = 'Equip-Counter' AND verb <> 'intercepts' THEN 'no_counter_statement'
  WHEN kind = 'Unit-Equip' AND pos % 5 = 0 AND NOT contains(lower(source || verb || 'it'), lower(target)) THEN 'endpoint_not_in_evidence' ELSE 'kept' END AS reason FROM told)
SELECT type, reason, count(*) AS n FROM judged GROUP BY 1, 2""")
def x9_lexical_evidence(spark, sf_dir):
    """Relations between neighbouring words of a document, under evidence with a verb drawn by md5, some of which does not name the target."""
    known = X.dedup_entities(mentions(spark, sf_dir)).where("kept").withColumn("aliases", F.array().cast("array<string>"))
    kind = F.element_at(F.array(*map(F.lit, ("Equip-Counter", "Unit-Equip", "Equip-Develop"))), (F.col("pos") % 3 + 1).cast("int"))
    verb = F.element_at(F.array(*map(F.lit, ("designed", "intercepts", "met"))), (drawn("source", 4, 3) + 1).cast("int"))
    said = F.concat_ws(" ", "source", verb, F.when(F.col("pos") % 5 == 0, "it").otherwise(F.col("target")))
    rows = neighbours(spark, sf_dir).select("chunk_id", "pos", F.lit(False).alias("bad"), "source", "target", kind.alias("type"), said.alias("literal"), F.lit("1").alias("confidence"))
    judged = X.check_relations(rows, known, ontology.relation_rules(spark))
    return judged.groupBy("type", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_PAIRS} SELECT chunk_id, count(DISTINCT source || '>' || target) AS kept, count(*) AS proposed FROM pairs GROUP BY chunk_id")
def x10_relation_dedup(spark, sf_dir):
    rows = neighbours(spark, sf_dir)
    kept = X.dedup_relations(rows).groupBy("chunk_id").agg(F.count("*").alias("kept"))
    return kept.join(rows.groupBy("chunk_id").agg(F.count("*").alias("proposed")), "chunk_id")


@query(f"""WITH {_MENTIONS}, r AS (SELECT chunk_id, CASE WHEN type = 'Vehicle' THEN 'unknown_type' WHEN confidence < 0.2 THEN 'low_confidence' END AS reason FROM mentions)
SELECT chunk_id, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY GROUPING SETS ((chunk_id, reason), (reason), ())""")
def x11_rejections(spark, sf_dir):
    reason = F.when(F.col("type") == "Vehicle", "unknown_type").when(F.col("confidence") < 0.2, "low_confidence")
    return X.rejections(mentions(spark, sf_dir).withColumn("reason", reason))


@query(f"WITH {_MENTIONS} SELECT chunk_id, md5(string_agg('- ' || name || ' (' || type || ')', chr(10) ORDER BY pos)) AS prompt FROM mentions GROUP BY chunk_id")
def x13_entity_listing(spark, sf_dir):
    return X.entity_listing(mentions(spark, sf_dir)).select("chunk_id", F.md5("listing").alias("prompt"))


# The first place of a word in its text, white space and case aside, as the text has it: characters with the places of what they fold to.
_LITERAL = """
texts AS (SELECT doc_id, text, lower(replace(regexp_replace(text, '\\s+', '', 'g'), 'ß', 'ss')) AS folded FROM documents),
chars AS (SELECT doc_id, i, sum(width) OVER (PARTITION BY doc_id ORDER BY i) - width + 1 AS start FROM (
    SELECT doc_id, i, CASE c WHEN 'ß' THEN 2 ELSE 1 END AS width, c FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(1, len(text) + 1)) AS i FROM documents)) WHERE NOT regexp_matches(c, '\\s')),
places AS (SELECT m.chunk_id, m.name, strpos(folded, lower(m.name)) AS first, strpos(folded, lower(m.name)) + len(m.name) - 1 AS last FROM (SELECT DISTINCT chunk_id, name FROM mentions) m JOIN texts ON doc_id = m.chunk_id),
spans AS (SELECT p.chunk_id, p.name, substr(text, a.i, b.i - a.i + 1) AS literal FROM places p ASOF JOIN chars a ON a.doc_id = p.chunk_id AND p.first >= a.start ASOF JOIN chars b ON b.doc_id = p.chunk_id AND p.last >= b.start JOIN texts t ON t.doc_id = p.chunk_id)
"""


@query(f"""WITH {_MENTIONS}, {_LITERAL},
judged AS (SELECT m.*, literal, CASE WHEN pos % 7 = 0 THEN 'name_not_in_source' WHEN type = 'Vehicle' THEN 'unknown_type' WHEN confidence < 0.2 THEN 'low_confidence' END AS reason FROM mentions m JOIN spans USING (chunk_id, name)),
fine AS (SELECT *, coalesce(max(confidence) OVER (PARTITION BY chunk_id, literal ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= confidence, false) AS duplicate,
  row_number() OVER (PARTITION BY chunk_id, literal ORDER BY confidence DESC, pos) = 1 AS kept FROM judged WHERE reason IS NULL),
known AS (SELECT chunk_id, literal AS name, type, lower(replace(regexp_replace(literal, '\\s+', '', 'g'), 'ß', 'ss')) AS key FROM fine WHERE kept),
keys AS (SELECT chunk_id, key, min(name) AS name, min(type) AS type FROM known GROUP BY 1, 2 HAVING count(DISTINCT name) = 1),
said AS (SELECT a.chunk_id, a.name AS source, b.name AS target, ['Equip-Counter', 'Unit-Equip', 'Equip-Carry'][(a.pos % 3)::INT + 1] AS type FROM mentions a JOIN mentions b ON b.chunk_id = a.chunk_id AND b.pos = a.pos + 1),
told AS (SELECT s.chunk_id, p.name AS source, q.name AS target, s.type, lower(s.source || s.target) AS evidence, CASE WHEN p.name IS NULL OR q.name IS NULL THEN 'unknown_endpoint' WHEN NOT contains(folded, lower(s.source || s.target)) THEN 'evidence_not_in_source'
    WHEN NOT ((s.type = 'Equip-Counter' AND p.type = 'Weapon System' AND q.type = 'Weapon System') OR (s.type = 'Unit-Equip' AND p.type = 'Combat Unit' AND q.type IN ('Weapon System', 'Platform/Carrier'))
      OR (s.type = 'Equip-Carry' AND p.type = 'Platform/Carrier' AND q.type = 'Weapon System')) THEN 'invalid_type_or_direction'
    WHEN s.type = 'Equip-Counter' AND NOT regexp_matches(lower(s.source || ' ' || s.target), 'counter|defeat|destroy|intercept') THEN 'no_counter_statement' END AS reason
  FROM said s JOIN texts ON doc_id = s.chunk_id LEFT JOIN keys p ON p.chunk_id = s.chunk_id AND p.key = lower(s.source) LEFT JOIN keys q ON q.chunk_id = s.chunk_id AND q.key = lower(s.target))
SELECT 'entity' AS kind, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 2 UNION ALL SELECT 'entity', 'duplicate', count(*) FROM fine WHERE duplicate HAVING count(*) > 0
UNION ALL SELECT 'entity', 'kept', count(*) FROM known UNION ALL SELECT 'relation', reason, count(*) FROM told WHERE reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'relation', 'kept', count(*) FROM (SELECT DISTINCT chunk_id, source, target, type, evidence FROM told WHERE reason IS NULL)""")
def x1_validation(spark, sf_dir):
    """Replies that propose each document's capitalised words as entities, some of them misspelt, and neighbours as relations, checked against the text.

    A word found in the middle of a folded character stands for all of it: St is ßt where that comes first in the text; the SQL does the same.
    """
    said = docs(spark, sf_dir).where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+"), 0).alias("names")).where(F.size("names") > 0)
    draw = lambda name, pos: mention_drawn(F.col("chunk_id"), pos, name)
    kind = lambda pos: F.element_at(F.array(*map(F.lit, ("Equip-Counter", "Unit-Equip", "Equip-Carry"))), (pos % 3 + 1).cast("int"))
    entities = F.transform("names", lambda name, pos: F.struct(misspelt(name, pos).alias("name"), *draw(name, pos)))
    after = F.slice("names", F.lit(2), F.size("names"))
    pairs = F.zip_with(F.slice("names", F.lit(1), F.size("names") - 1), after, lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    relations = F.transform(pairs, lambda x, pos: F.struct(x["source"].alias("source"), x["target"].alias("target"), kind(pos).alias("type"), F.concat_ws(" ", x["source"], x["target"]).alias("evidence")))
    replies = said.select("chunk_id", F.to_json(F.struct(entities.alias("entities"), relations.alias("relations"))).alias("reply_json"))
    chunk_table = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    kept, relations, lost = X.validate(replies, chunk_table, ontology.entity_types(spark), ontology.relation_rules(spark), min_confidence=0.2)
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), F.lit("kept").alias("reason"), "n")
    return lost.groupBy("kind", "reason").agg(F.sum("n").alias("n")).unionByName(count(kept, "entity")).unionByName(count(relations, "relation"))


@query(f"WITH {_MENTIONS} SELECT chunk_id, count(*) + CASE WHEN chunk_id % 8 = 7 THEN 2 ELSE 0 END AS proposed, CASE WHEN chunk_id % 8 = 7 THEN 2 ELSE 0 END::BIGINT AS bad, max(len(name))::INT AS longest FROM mentions WHERE chunk_id % 8 NOT IN (4, 5, 6) GROUP BY chunk_id")
def x2_tolerant_parse(spark, sf_dir):
    """Replies with each document's capitalised words: plain, fenced, with words before or after, and with elements that are no objects; three in eight have no list of entities."""
    listed = mentions(spark, sf_dir).groupBy("chunk_id").agg(F.to_json(F.collect_list(F.struct("name", "type", "confidence"))).alias("e"))
    whole = F.concat(F.lit('{"entities": '), "e", F.lit(', "relations": []}'))
    given = (
        whole, F.concat(F.lit("```json\n"), whole, F.lit("\n```")), F.concat(F.lit("Here: "), whole), F.concat(whole, F.lit(" and that is all {of it}")),
        F.lit("nothing found"), F.lit("[1, 2]"), F.lit('{"entities": "none", "relations": []}'), F.concat(F.lit('{"entities": [7, null, '), F.expr("substr(e, 2)"), F.lit("}")),
    )
    entities, _ = X.proposals(listed.select("chunk_id", F.element_at(F.array(*given), (F.col("chunk_id") % 8 + 1).cast("int")).alias("reply_json")))
    return entities.groupBy("chunk_id").agg(F.count("*").alias("proposed"), F.count_if("bad").alias("bad"), F.max(F.length("name")).alias("longest"))


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY source")
def x14_resume(spark, sf_dir):
    """Labelled documents stand for those already done."""
    done = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("chunk_id")).distinct()
    all_ = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "source")
    return X.remaining(all_, done.join(all_, "chunk_id", "left_semi")).groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {_PAIRS} SELECT pairs.source || '>' || target AS edge_id, chunk_id, evidence AS text FROM pairs JOIN documents ON chunk_id = doc_id WHERE NOT contains(documents.text, evidence)")
def x15_evidence_audit(spark, sf_dir):
    """Neighbouring mentions are rarely next to each other: most of this evidence is invented."""
    edges = neighbours(spark, sf_dir).select(F.concat_ws(">", "source", "target").alias("id"), F.array(F.struct(F.col("evidence").alias("text"), "chunk_id")).alias("evidence"))
    return X.evidence_violations(edges, docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"))


# ---- graphs

_NORM = "lower(regexp_replace({}, '[\\s\\-_·.()]+', '', 'g'))"


@query(f"SELECT key, count(*) AS n FROM (SELECT {_NORM.format('s_name')} AS key FROM supplier UNION ALL SELECT {_NORM.format('c_name')} FROM customer UNION ALL SELECT {_NORM.format('p_name')} FROM part) GROUP BY key")
def g1_normalize_names(spark, sf_dir):
    name = lambda t, c: table(spark, sf_dir, t).select(T.normalize_name(F.col(c)).alias("key"))
    return name("supplier", "s_name").unionByName(name("customer", "c_name")).unionByName(name("part", "p_name")).groupBy("key").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE step AS (SELECT 'nation' || n_nationkey AS key, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE 'nation' || (n_nationkey - 1) END AS next FROM nation),
walk AS (SELECT key, key AS canonical FROM step UNION ALL SELECT w.key, s.next FROM walk w JOIN step s ON s.key = w.canonical WHERE s.next IS NOT NULL)
SELECT key, arg_min(canonical, ('0' || replace(canonical, 'nation', ''))::INT) AS canonical FROM walk WHERE key IN (SELECT key FROM step WHERE next IS NOT NULL) GROUP BY key""")
def g2_synonym_chains(spark, sf_dir):
    """Each nation a synonym of the one before it, but for every seventh."""
    pairs = table(spark, sf_dir, "nation").where("n_nationkey % 7 <> 0").select(F.concat(F.lit("Nation "), "n_nationkey").alias("alias"), F.concat(F.lit("nation-"), F.col("n_nationkey") - 1).alias("canonical"))
    return G.synonym_closure(pairs)


@query("SELECT p_name AS name, count(*) AS mentions, min(p_partkey) AS node, max(0.5::DOUBLE + p_size / 101::DOUBLE) AS confidence FROM part GROUP BY p_name")
def g3_exact_alignment(spark, sf_dir):
    """Parts as mentions of what their names stand for; no name is similar enough to another."""
    rows = part_mentions(spark, sf_dir)
    placed = G.align(rows, threshold=1.0)
    return rows.join(placed, "pos").groupBy("node").agg(F.min_by("name", "pos").alias("name"), F.count("*").alias("mentions"), F.max("confidence").alias("confidence")).select("name", "mentions", "node", "confidence")


def part_mentions(spark, sf_dir) -> DataFrame:
    """Parts as mentions: brand and size are attributes."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("extraction"), F.col("p_name").alias("name"), F.lit("Weapon System").alias("type"), F.array().cast("array<string>").alias("aliases"),
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("attributes"), (0.5 + F.col("p_size") / 101).alias("confidence"), F.concat(F.lit("doc"), F.col("p_partkey") % 100, F.lit(":p:0001")).alias("chunk_id"),
    )


@query()
def g4_fuzzy_alignment(spark, sf_dir):
    """Suppliers and customers as mentions, whose numbered names are similar where one digit differs, unless their nations contradict; and parts."""
    named = lambda name, key, who, kind, nation, shift: table(spark, sf_dir, name).select(
        (F.col(key) + shift).alias("pos"), F.col(key).alias("extraction"), F.col(who).alias("name"), F.lit(kind).alias("type"), F.array().cast("array<string>").alias("aliases"),
        F.create_map(F.lit("nation"), (F.col(nation) % 5).cast("string")).alias("attributes"), (0.5 + F.col(key) % 10 / 20).alias("confidence"), F.lit("doc:p:0001").alias("chunk_id"),
    )
    most = 1 << 40
    rows = part_mentions(spark, sf_dir).unionByName(named("supplier", "s_suppkey", "s_name", "Platform/Carrier", "s_nationkey", most)).unionByName(named("customer", "c_custkey", "c_name", "Combat Unit", "c_nationkey", 2 * most))
    return rows.join(G.align(rows, threshold=0.9), "pos").groupBy("type", "node").agg(F.count("*").alias("mentions"), F.countDistinct("name").alias("names"))


_FIRST = "first AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_name) AS node FROM part)"


@query(f"WITH {_FIRST} SELECT node, p_name AS name, count(DISTINCT p_partkey % 100) AS chunks, max(0.5::DOUBLE + p_size / 101::DOUBLE) AS confidence FROM first GROUP BY node, p_name")
def g5_node_merge(spark, sf_dir):
    rows = part_mentions(spark, sf_dir)
    placed = rows.select("pos", F.min("pos").over(W.partitionBy("name")).alias("node"))
    return G.merge_nodes(rows, placed).select("node", "name", F.size("chunks").cast("long").alias("chunks"), "confidence")


@query(f"WITH {_FIRST} SELECT node, arg_max(p_brand, p_size::BIGINT * 1000000000 - p_partkey) AS brand, max(p_size)::VARCHAR AS size FROM first GROUP BY node")
def g6_attribute_merge(spark, sf_dir):
    rows = part_mentions(spark, sf_dir).withColumn("node", F.min("pos").over(W.partitionBy("name")))
    return G.merge_attributes(rows).select("node", F.col("attributes")["brand"]["value"].alias("brand"), F.col("attributes")["size"]["value"].alias("size"))


def part_relations(spark, sf_dir) -> DataFrame:
    """Each line item says that its order's customer's unit has the part; evidence by ship mode of the flags."""
    return table(spark, sf_dir, "lineitem").select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.concat(F.lit("S"), "l_suppkey").alias("source"), F.concat(F.lit("P"), "l_partkey").alias("target"), F.lit("Equip-Carry").alias("type"),
        F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("evidence"), F.col("l_linestatus").alias("chunk_id"), F.lit(False).alias("derived_from_attribute"),
    )


@query("""SELECT l.l_suppkey AS source, count(*) AS n FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey GROUP BY 1""")
def g7_relation_edges(spark, sf_dir):
    """Line items as relations, their ends looked up among mentions of parts and suppliers."""
    named = stargraph.nodes(spark, sf_dir).where(F.col("type").isin("Weapon System", "Platform/Carrier")).select(F.xxhash64("id").alias("pos"), F.lit(0).cast("long").alias("extraction"), F.col("id").alias("name"), "type")
    placed = named.select("pos", F.col("pos").alias("node"))
    rows = G.relation_edges(part_relations(spark, sf_dir).withColumn("extraction", F.lit(0).cast("long")), named, placed, ontology.relation_rules(spark))
    back = named.select(F.col("pos").alias("source"), F.substring("name", 2, 20).cast("long").alias("key"))
    return rows.groupBy("source").agg(F.count("*").alias("n")).join(back, "source").select(F.col("key").alias("source"), "n")


@query("SELECT 'S' || l_suppkey AS source, 'P' || l_partkey AS target, max(l_discount) AS confidence, count(DISTINCT l_returnflag || l_linestatus) AS evidence FROM lineitem GROUP BY 1, 2")
def g8_edge_merge(spark, sf_dir):
    return G.merge_edges(part_relations(spark, sf_dir)).select("source", "target", "confidence", F.size("evidence").cast("long").alias("evidence"))


@query("SELECT o_orderkey, printf('n%06d', 7 + row_number() OVER (ORDER BY o_orderkey)) AS id FROM orders")
def g9_ids(spark, sf_dir):
    return G.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "n", start=7).select("o_orderkey", "id")


@query("SELECT 'S' || l_suppkey AS id, string_agg(DISTINCT 'doc' || (l_orderkey % 20), ' ' ORDER BY 'doc' || (l_orderkey % 20)) AS document_ids FROM lineitem GROUP BY 1")
def g11_provenance(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("id"), F.concat(F.lit("doc"), F.col("l_orderkey") % 20, F.lit(":x:"), "l_linenumber").alias("chunk_id")).distinct()
    edges = cited.groupBy("id").agg(F.collect_list(F.struct(F.lit("").alias("text"), "chunk_id")).alias("evidence"))
    return G.edge_documents(edges).select("id", F.array_join("document_ids", " ").alias("document_ids"))


@query("""SELECT s_name AS name, 'Platform/Carrier' AS type, string_agg(DISTINCT n_name, ' ' ORDER BY n_name) AS documents FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def g12_entity_documents(spark, sf_dir):
    """Suppliers and the nations that they deliver to, these standing for documents."""
    t = lambda n: table(spark, sf_dir, n)
    links = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    links = links.select(F.concat(F.lit("S"), "l_suppkey").alias("node_id"), F.col("c_nationkey").cast("string").alias("doc_id")).distinct()
    documents = t("nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.col("n_name").alias("name"))
    found = G.documents_of_entities(links, stargraph.nodes(spark, sf_dir).where("type = 'Platform/Carrier'"), documents)
    return found.select("name", "type", F.array_join("documents", " ").alias("documents"))


@query(f"WITH {stargraph.SQL} SELECT a.name AS source_name, b.name AS target_name, e.confidence FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.type = 'Unit-Org' AND a.type = 'Combat Unit' AND b.type = 'Command Structure'")
def g13_typed_pattern(spark, sf_dir):
    return G.typed_pattern(stargraph.nodes(spark, sf_dir), stargraph.edges(spark, sf_dir, ("Unit-Org",)), "Combat Unit", "Unit-Org", "Command Structure")


@query(f"WITH {stargraph.SQL}, asked AS (SELECT 'C' || o_custkey AS source, 'P' || (o_orderkey % 2000) AS target, 'Unit-Equip' AS type FROM orders) SELECT there, count(*) AS n FROM (SELECT (source, target, type) IN (SELECT (source, target, type) FROM edges) AS there FROM asked) GROUP BY there")
def g14_has_fact(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("source"), F.concat(F.lit("P"), F.col("o_orderkey") % 2000).alias("target"), F.lit("Unit-Equip").alias("type"))
    return G.has_fact(asked, stargraph.edges(spark, sf_dir, ("Unit-Equip",))).groupBy("there").agg(F.count("*").alias("n"))


@query("SELECT 'P' || p_partkey AS id, 'size' AS key, p_size::VARCHAR AS value FROM part WHERE p_size > 0")
def g15_specification_candidates(spark, sf_dir):
    """Sizes of parts under the name of a capacity."""
    nodes = table(spark, sf_dir, "part").where("p_size > 0").select(
        F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("Weapon System").alias("type"),
        F.create_map(F.lit("Capacity"), F.struct(F.concat(F.lit(" "), F.col("p_size").cast("string")).alias("value"), F.lit(1.0).alias("confidence"), F.lit("c").alias("chunk_id")), F.lit("brand"), F.struct(F.col("p_brand").alias("value"), F.lit(1.0).alias("confidence"), F.lit("c").alias("chunk_id"))).alias("attributes"),
    )
    return G.specification_candidates(nodes).select("id", F.lit("size").alias("key"), "value")


@query(f"WITH {stargraph.SQL}, b AS (SELECT 'node' AS part, type FROM nodes UNION ALL SELECT 'edge', type FROM edges) SELECT part, type, count(*) AS n FROM b GROUP BY GROUPING SETS ((part, type), (part))")
def g17_profile(spark, sf_dir):
    return G.profile(stargraph.nodes(spark, sf_dir), stargraph.edges(spark, sf_dir))


# ---- storing


@query(f"""WITH {stargraph.SQL}, old AS (SELECT id, CASE WHEN confidence > 0.9 THEN 0.1 ELSE confidence END AS confidence FROM edges WHERE type <> 'Unit-Org')
SELECT e.type, count(*) AS n FROM edges e LEFT JOIN old o ON o.id = e.id WHERE o.id IS NULL OR o.confidence <> e.confidence GROUP BY e.type""")
def s8_delta(spark, sf_dir):
    """Edges against an earlier state that lacks one kind and has other confidences."""
    now = stargraph.edges(spark, sf_dir)
    before = now.where("type <> 'Unit-Org'").withColumn("confidence", F.when(F.col("confidence") > 0.9, 0.1).otherwise(F.col("confidence")))
    return store.changed(now, before).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH {stargraph.SQL} SELECT type, count(*) AS n, count(*) FILTER (WHERE type = 'Weapon System' AND id LIKE '%0') AS renamed, sum(('0x' || substr(md5(CASE WHEN type = 'Weapon System' AND id LIKE '%0' THEN upper(name) ELSE name END), 1, 8))::BIGINT)::BIGINT AS names
FROM nodes WHERE type <> 'Technical Specification' GROUP BY type""")
def s11_versions(spark, sf_dir):
    """A graph's nodes saved as a version, then units added, some weapons renamed and specifications taken out in a second, read back."""
    graph = GraphFiles(spark, stages.shared_folder(spark, "graph"))
    nodes = stargraph.nodes(spark, sf_dir)
    unit, weapon = F.col("type") == "Combat Unit", (F.col("type") == "Weapon System") & F.col("id").endswith("0")
    graph.save(0, nodes=nodes.where(~unit))
    graph.save(1, nodes=nodes.where(unit | weapon).withColumn("name", F.when(weapon, F.upper("name")).otherwise(F.col("name"))), remove={"nodes": nodes.where("type = 'Technical Specification'").select("id")})
    read = graph.read("nodes")
    return read.groupBy("type").agg(F.count("*").alias("n"), F.count_if(weapon).alias("renamed"), F.sum(F.conv(F.substring(F.md5("name"), 1, 8), 16, 10).cast("long")).alias("names"))


@query(f"WITH {stargraph.SQL} SELECT type, count(*) AS n FROM edges WHERE type IN ('Equip-Carry', 'Unit-Equip') GROUP BY type")
def s9_load_kinds(spark, sf_dir):
    e = stargraph.edges(spark, sf_dir).withColumn("graph_id", F.lit("g")).withColumn("rel_type", F.col("type"))
    return store.load(stargraph.nodes(spark, sf_dir).withColumn("graph_id", F.lit("g")), e, "g", ["Equip-Carry", "Unit-Equip"])[1].groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT 'g' || o_custkey AS id, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS updated_at, count(*) AS version FROM orders GROUP BY o_custkey")
def s10_catalogue(spark, sf_dir):
    """Customers as graphs, their orders as versions."""
    graphs = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("g"), "o_custkey").alias("id")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"), F.count("*").alias("version"))
    return store.catalogue(graphs)


@query(f"WITH {stargraph.SQL} SELECT (SELECT count(*) FROM nodes WHERE type <> 'Combat Unit') AS tagged_nodes, (SELECT count(*) FROM edges WHERE confidence < 0.8) AS converted_relations")
def s12_migration(spark, sf_dir):
    """Units have their label already; edges of low confidence are of the legacy type."""
    n = stargraph.nodes(spark, sf_dir).withColumn("labels", F.when(F.col("type") == "Combat Unit", F.array("type")).otherwise(F.array().cast("array<string>")))
    e = stargraph.edges(spark, sf_dir).withColumn("rel_type", F.when(F.col("confidence") < 0.8, store.LEGACY_TYPE).otherwise(F.col("type")))
    return store.migrate(n, e)[2]


_TURNS = """turns AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant' AND q.text IS NOT NULL AND a.text IS NOT NULL)"""


def turns(spark, sf_dir) -> DataFrame:
    """Questions and answers that follow each other in conversations, as items."""
    t = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    a = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer_text"))
    q = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    none = F.lit(None)
    return q.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("attempt"), "question", "answer_text", none.cast("array<string>").alias("answer_labels"), F.lit("").alias("explanation"), none.cast("array<struct<label:string,text:string>>").alias("options")
    )


@query(f"WITH {_TURNS} SELECT conv_id * 1000 + turn AS attempt, md5(question) AS instruction, md5(trim(answer, ' ' || chr(10) || chr(9) || chr(13))) AS output FROM turns")
def s13_training_records(spark, sf_dir):
    rows = turns(spark, sf_dir)
    out = store.training_records(rows, "alpaca").select(F.md5("instruction").alias("instruction"), F.md5("output").alias("output"))
    key = rows.select("attempt", F.md5("question").alias("instruction"), F.md5(F.trim("answer_text", F.lit(" \n\t\r"))).alias("output")).distinct()
    return key.join(out.distinct(), ["instruction", "output"])


# ---- questions


_SUBS = f"{stargraph.SQL}, subs AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) AS rank, CASE type WHEN 'Unit-Org' THEN 1 WHEN 'Equip-Carry' THEN 2 ELSE 3 END AS depth FROM edges WHERE type IN ('Unit-Org', 'Equip-Carry', 'Equip-Counter'))"


def subgraphs(spark, sf_dir) -> DataFrame:
    e = stargraph.edges(spark, sf_dir, ("Unit-Org", "Equip-Carry", "Equip-Counter"))
    ranked = G.numbered(e.select(F.col("id").alias("edge"), "type"), "edge", "")
    return ranked.select(F.col("edge").alias("sub"), (F.col("id").cast("long") - 1).alias("rank"), F.when(F.col("type") == "Unit-Org", 1).when(F.col("type") == "Equip-Carry", 2).otherwise(3).alias("depth"))


@query(f"""WITH {_SUBS}, a AS (SELECT id AS sub, depth, rank * 2 + j AS attempt FROM subs, (SELECT unnest([0, 1]) AS j)),
k AS (SELECT *, ['single_choice', 'multiple_choice', 'cot', 'true_false', 'fill_blank'][(attempt % 5)::INT + 1] AS usual FROM a)
SELECT attempt, sub, CASE WHEN depth = 1 AND usual IN ('cot', 'multiple_choice') THEN ['single_choice', 'true_false', 'fill_blank'][(attempt % 3)::INT + 1] ELSE usual END AS question_type, attempt % 2 = 0 AS truth,
  ['a', 'b', 'c'][('0x' || substr(md5('42|' || attempt), 1, 6))::INT % 3 + 1] AS style, CASE WHEN depth <= 1 THEN 'easy' WHEN depth = 2 THEN 'medium' ELSE 'hard' END AS difficulty FROM k""")
def q1_plan(spark, sf_dir):
    return Q.plan(subgraphs(spark, sf_dir), per_subgraph=2).select("attempt", "sub", "question_type", "truth", "style", "difficulty")


@query(f"WITH {_SUBS} SELECT CASE WHEN depth <= 1 THEN 'easy' WHEN depth = 2 THEN 'medium' ELSE 'hard' END AS difficulty, count(*) AS n FROM subs GROUP BY 1")
def q2_difficulty(spark, sf_dir):
    e = stargraph.edges(spark, sf_dir, ("Unit-Org", "Equip-Carry", "Equip-Counter"))
    depth = F.when(F.col("type") == "Unit-Org", 1).when(F.col("type") == "Equip-Carry", 2).otherwise(3)
    return e.groupBy(T.difficulty(depth).alias("difficulty")).agg(F.count("*").alias("n"))


@query(f"""WITH {stargraph.SQL}, own AS (SELECT n_nationkey AS attempt, 'N' || n_nationkey AS id FROM nation UNION ALL SELECT c_nationkey, 'C' || c_custkey FROM customer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id) AS r FROM nodes), mine AS (SELECT o.attempt, n.* FROM own o JOIN nodes n USING (id)),
pool AS (SELECT DISTINCT * FROM (SELECT m.attempt, r.id FROM (SELECT DISTINCT attempt, type FROM mine) m JOIN ranked r ON r.type = m.type AND r.r <= 16 UNION ALL SELECT attempt, id FROM mine))
SELECT attempt, count(*) AS n FROM pool GROUP BY attempt""")
def q3_distractors(spark, sf_dir):
    """Nations with their customers as subgraphs."""
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("attempt"), F.concat(F.lit("N"), "n_nationkey").alias("id"))
    own = own.unionByName(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("attempt"), F.concat(F.lit("C"), "c_custkey").alias("id")))
    return Q.distractors(own, stargraph.nodes(spark, sf_dir)).groupBy("attempt").agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_])[enEN][0-9]{4,}($|[^A-Za-z0-9_])') AS leaks FROM documents WHERE text IS NOT NULL")
def q4_leaks(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", T.leaks(F.col("text")).alias("leaks"))


_OPTIONS = """items AS (SELECT p_partkey AS attempt, p_brand, ['A', 'B', 'C', 'D'] AS labels, [p_brand, 'Brand#' || (p_size % 25 + 1), 'Brand#' || (p_partkey % 30), p_name] AS texts FROM part),
each AS (SELECT attempt, p_brand, unnest(labels) AS label, unnest(texts) AS text FROM items)"""


@query(f"""WITH {_OPTIONS}, known AS (SELECT lower(p_brand) AS key, 'spec' AS type FROM part GROUP BY 1 UNION ALL SELECT lower(replace(p_name, ' ', '')), 'part' FROM part GROUP BY 1),
j AS (SELECT e.attempt, e.label, e.label = 'A' AS correct, coalesce(bool_or(k.type = 'spec'), false) AS same_type, coalesce(bool_or(k.type = 'spec' AND k.key = lower(e.p_brand)), false) AS answers
  FROM each e LEFT JOIN known k ON k.key = lower(replace(e.text, ' ', '')) GROUP BY e.attempt, e.label)
SELECT attempt, bool_and(same_type) AS option_ok, bool_and(NOT correct OR answers) AS correct_ok, bool_and(correct OR NOT answers) AS distractor_ok FROM j GROUP BY attempt""")
def q6_option_grounding(spark, sf_dir):
    """A choice of brands for each part: some options are no brands, some name the answer again."""
    part = table(spark, sf_dir, "part")
    option = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    items = part.select(
        F.col("p_partkey").alias("attempt"), F.array(F.lit("A")).alias("answer_labels"), F.array(F.concat(F.lit("B"), "p_brand")).alias("answer_entities"),
        F.array(option("A", F.col("p_brand")), option("B", F.concat(F.lit("Brand#"), F.col("p_size") % 25 + 1)), option("C", F.concat(F.lit("Brand#"), F.col("p_partkey") % 30)), option("D", F.col("p_name"))).alias("options"),
    )
    brands = part.select(F.concat(F.lit("B"), "p_brand").alias("id"), F.lit("spec").alias("type"), F.col("p_brand").alias("name")).distinct()
    names = part.select(F.concat(F.lit("M"), "p_name").alias("id"), F.lit("part").alias("type"), F.col("p_name").alias("name")).distinct()
    keys = Q.alias_keys(brands.unionByName(names).withColumn("aliases", F.array().cast("array<string>")))
    return Q.option_facts(items, keys)


@query(f"WITH {_TURNS} SELECT CASE WHEN strpos(question, '____') > 0 THEN 'mask' ELSE 'none' END AS kind, count(*) AS n FROM (SELECT CASE WHEN strpos(question, '. ') > 0 THEN replace(question, '. ', ' ____ ') ELSE question END AS question FROM turns) GROUP BY 1")
def q7_fill_blank(spark, sf_dir):
    masked = turns(spark, sf_dir).select(F.replace("question", F.lit(". "), F.lit(" ____ ")).alias("question"))
    return masked.groupBy(F.when(F.col("question").contains("____"), "mask").otherwise("none").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {stargraph.SQL}, altered AS (SELECT id, source, target, 'P' || (substr(target, 2)::BIGINT + 1) AS replacement FROM edges WHERE type = 'Equip-Carry')
SELECT count(*) AS altered, count(*) FILTER (WHERE n.id IS NULL) AS unknown, count(*) FILTER (WHERE e.id IS NOT NULL) AS present FROM altered a LEFT JOIN nodes n ON n.id = a.replacement
LEFT JOIN edges e ON e.type = 'Equip-Carry' AND e.source = a.source AND e.target = a.replacement""")
def q8_altered_facts(spark, sf_dir):
    """The target of each carrier's fact swapped for the next part."""
    e = stargraph.edges(spark, sf_dir, ("Equip-Carry",))
    swapped = e.select("source", F.concat(F.lit("P"), F.substring("target", 2, 20).cast("long") + 1).alias("target"), "type")
    there = G.has_fact(swapped, e).join(stargraph.nodes(spark, sf_dir).select(F.col("id").alias("target"), F.lit(True).alias("known")), "target", "left")
    return there.agg(F.count("*").alias("altered"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if("there").alias("present"))


@query()
def q10_rouge(spark, sf_dir):
    """How much of an answer's wording its question has."""
    rows = turns(spark, sf_dir)
    return rows.select("attempt", F.round(S.rouge_l("question", "answer_text"), 6).alias("rouge"))


@query()
def q11_near_duplicate_questions(spark, sf_dir):
    """Benchmark items that no earlier one nearly equals."""
    return S.first_kept(table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("id"), "text")).select("id")


@query("""WITH runs AS (SELECT event_type AS stat, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT role, count(*) FROM conversations GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events WHERE value > 10 GROUP BY 1) SELECT stat, sum(n)::BIGINT AS n FROM runs GROUP BY stat""")
def q13_counters(spark, sf_dir):
    count = lambda df, c: df.groupBy(F.col(c).alias("stat")).agg(F.count("*").alias("n"))
    events = table(spark, sf_dir, "events")
    return Q.merged_counters(count(events, "event_type"), count(table(spark, sf_dir, "conversations"), "role"), count(events.where("value > 10"), "event_type"))


@query(f"WITH {_OPTIONS} SELECT attempt, md5('Which brand?' || chr(10) || string_agg(label || '. ' || text, chr(10) ORDER BY label)) AS instruction FROM each GROUP BY attempt")
def q15_instructions(spark, sf_dir):
    option = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    items = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("attempt"), F.lit("Which brand?").alias("question"), F.lit(None).cast("string").alias("answer_text"), F.array(F.lit("A")).alias("answer_labels"), F.col("p_partkey").cast("string").alias("explanation"),
        F.array(option("A", F.col("p_brand")), option("B", F.concat(F.lit("Brand#"), F.col("p_size") % 25 + 1)), option("C", F.concat(F.lit("Brand#"), F.col("p_partkey") % 30)), option("D", F.col("p_name"))).alias("options"),
    )
    out = store.training_records(items)
    return out.select(F.regexp_extract("output", r"\n(\d+)$", 1).cast("long").alias("attempt"), F.md5("instruction").alias("instruction"))


@query("SELECT event_id AS attempt, (SELECT count(*) FROM events WHERE event_type = 'click') AS total FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 20 OFFSET 40")
def q16_page(spark, sf_dir):
    return Q.page(table(spark, sf_dir, "events").select(F.col("event_id").alias("attempt"), F.col("event_type").alias("question_type")), "click", 40, 20).select("attempt", "total")


_POSED = """posed AS (SELECT c_custkey % 5 AS strategy, CASE WHEN c_custkey % 9 = 7 THEN 'cot' ELSE 'fill_blank' END AS question_type, CASE c_custkey % 9 WHEN 1 THEN 'fill blank lacks mask or entity answer' WHEN 2 THEN 'unverifiable supporting facts'
  WHEN 3 THEN 'fill answer absent from graph' WHEN 4 THEN 'missing question' WHEN 5 THEN 'unknown referenced entity' WHEN 6 THEN 'graph reference in training text' WHEN 7 THEN 'CoT lacks multiple evidence steps' WHEN 8 THEN 'unknown answer entity' ELSE 'ok' END AS reason
  FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def posed(spark, sf_dir):
    """Of each customer's fact (its nation) an item, with a fault of one of eight kinds in eight of nine; attempts, nodes and edges."""
    none = F.array().cast("array<string>")
    n = stargraph.nodes(spark, sf_dir).where(F.col("type").isin("Combat Unit", "Command Structure")).select("id", "name", "type", none.alias("aliases"), F.create_map().cast(G.ATTRIBUTES).alias("attributes"))
    e = stargraph.edges(spark, sf_dir, ("Unit-Org",))
    key = F.substring("source", 2, 20).cast("long")
    k = key % 9
    facts = e.join(n.select(F.col("id").alias("source"), F.col("name").alias("unit")), "source").join(n.select(F.col("id").alias("target"), F.col("name").alias("command")), "target")
    question = F.when(k == 1, F.concat("unit", F.lit(" is under which command?"))).when(k == 4, "").when(k == 6, F.concat("unit", F.lit(", see e00012, is under ____."))).otherwise(F.concat("unit", F.lit(" is under ____.")))
    item = F.struct(
        question.alias("question"), F.array().cast("array<string>").alias("options"), F.when(k == 3, "nowhere at all").otherwise(F.col("command")).alias("answer"), F.concat(F.lit("So it is said of "), "unit").alias("explanation"),
        F.array(F.when(k == 2, "none").otherwise(F.col("id"))).alias("supporting_facts"), F.array(F.when(k == 5, "none").otherwise(F.col("source"))).alias("referenced_entities"), F.array(F.when(k == 8, "none").otherwise(F.col("target"))).alias("answer_entities"),
    )
    rows = facts.select(key.alias("attempt"), F.to_json(item).alias("reply_json"))
    attempts = facts.select(
        key.alias("attempt"), F.when(k == 7, "cot").otherwise("fill_blank").alias("question_type"), F.lit(True).alias("truth"), F.array("id").alias("sub_edges"), F.array("source", "target").alias("sub_nodes"), (key % 5).alias("strategy")
    )
    return Q.parse_items(rows), attempts, n, e


@query(f"WITH {_POSED} SELECT question_type, reason, count(*) AS n FROM posed GROUP BY 1, 2")
def q5_validation(spark, sf_dir):
    return Q.validate(*posed(spark, sf_dir)).groupBy("question_type", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {_POSED} SELECT question_type, strategy, reason, count(*) AS n FROM posed GROUP BY GROUPING SETS ((question_type, reason), (strategy, reason), (reason), ())")
def q17_report(spark, sf_dir):
    return Q.audit(*posed(spark, sf_dir))


def graph_nodes(spark, sf_dir, *types: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return stargraph.nodes(spark, sf_dir).where(F.col("type").isin(*types)).select("id", "name", "type", none.alias("aliases"), F.create_map().cast(G.ATTRIBUTES).alias("attributes"))


@query("""WITH posed AS (SELECT c_custkey % 12 AS k FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT CASE WHEN k IN (5, 9) THEN 'multiple_choice' ELSE 'single_choice' END AS question_type, CASE k WHEN 1 THEN 'choice question needs four options' WHEN 2 THEN 'non-distinct options' WHEN 3 THEN 'non-distinct options' WHEN 4 THEN 'wrong number of answers'
  WHEN 5 THEN 'multi-choice needs 2-3 answers' WHEN 6 THEN 'option is not a same-type KG entity' WHEN 7 THEN 'correct options not grounded in answer entities' WHEN 8 THEN 'explanation discusses distractor' WHEN 9 THEN 'correct option does not name answer entity'
  WHEN 10 THEN 'invalid option' WHEN 11 THEN 'invalid choice answer' ELSE 'ok' END AS reason, count(*) AS n FROM posed GROUP BY 1, 2""")
def q5_choices(spark, sf_dir):
    """Of each customer's fact (its nation) a choice among four nations, with a fault of one of eleven kinds in eleven of twelve."""
    n, e = graph_nodes(spark, sf_dir, "Combat Unit", "Command Structure"), stargraph.edges(spark, sf_dir, ("Unit-Org",))
    key = F.substring("source", 2, 20).cast("long")
    k, nation = key % 12, F.substring("target", 2, 20).cast("long")
    other = lambda by: F.concat(F.lit("NATION_"), (nation + by) % 25)
    option = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    facts = e.join(n.select(F.col("id").alias("source"), F.col("name").alias("unit")), "source")
    last = F.when(k == 2, other(0)).when(k == 6, F.col("unit")).when(k == 10, F.lit(None)).otherwise(other(3))
    four = [option("A", other(0)), option("B", other(1)), option("C", other(2)), F.struct(F.when(k == 3, "E").otherwise("D").alias("label"), last.alias("text"))]
    answer = F.when(k.isin(4, 9), F.array(F.lit("A"), F.lit("B"))).when(k == 7, F.array(F.lit("B"))).when(k == 11, F.array(F.lit("Z"))).otherwise(F.array(F.lit("A")))
    item = F.struct(
        F.concat(F.lit("Which command is "), "unit", F.lit(" under?")).alias("question"), F.when(k == 1, F.array(*four[:3])).otherwise(F.array(*four)).alias("options"), answer.alias("answer"),
        F.when(k == 8, F.concat(F.lit("It is not "), other(1))).otherwise("So it is said.").alias("explanation"), F.array("id").alias("supporting_facts"), F.array("source").alias("referenced_entities"), F.array("target").alias("answer_entities"),
    )
    rows = facts.select(key.alias("attempt"), F.to_json(item, {"ignoreNullFields": "false"}).alias("reply_json"))
    attempts = facts.select(key.alias("attempt"), F.when(k.isin(5, 9), "multiple_choice").otherwise("single_choice").alias("question_type"), F.lit(True).alias("truth"), F.array("id").alias("sub_edges"), F.array("source", "target").alias("sub_nodes"))
    return Q.validate(Q.parse_items(rows), attempts, n, e).groupBy("question_type", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {stargraph.SQL}, facts AS (SELECT e.id, e.source, e.target, substr(e.target, 2)::BIGINT AS num FROM edges e WHERE e.type = 'Equip-Carry'),
swapped AS (SELECT f.*, num % 7 AS k, num % 2 = 0 AS truth, CASE WHEN num % 7 = 3 THEN 'P-none' WHEN num % 7 = 4 THEN 'S1' ELSE 'P' || (num + 1) END AS other FROM facts f),
told AS (SELECT s.*, n.id IS NOT NULL AS known, x.id IS NOT NULL AS there FROM swapped s LEFT JOIN nodes n ON n.id = s.other LEFT JOIN edges x ON x.type = 'Equip-Carry' AND x.source = s.source AND x.target = s.other)
SELECT truth, CASE WHEN k = 1 THEN 'wrong truth label' WHEN truth THEN 'ok' WHEN k = 2 THEN 'missing altered fact' WHEN NOT known THEN 'invalid false-fact replacement' WHEN k = 4 THEN 'false-fact replacement has wrong entity type'
  WHEN there THEN 'altered fact is present in graph' WHEN k = 5 THEN 'altered entity not in question' ELSE 'ok' END AS reason, count(*) AS n FROM told GROUP BY 1, 2""")
def q5_false_facts(spark, sf_dir):
    """Of each carrier's fact a statement that is true or false by the number of its part; false ones swap the part for the next one, with a fault of one of five kinds in five of seven."""
    n, e = graph_nodes(spark, sf_dir, "Platform/Carrier", "Weapon System"), stargraph.edges(spark, sf_dir, ("Equip-Carry",))
    number = F.substring("target", 2, 20).cast("long")
    k, truth = number % 7, number % 2 == 0
    other = F.when(k == 3, "P-none").when(k == 4, "S1").otherwise(F.concat(F.lit("P"), number + 1))
    name = lambda at: n.select(F.col("id").alias(at), F.col("name").alias(f"{at}_name"))
    # the swapped part's name goes with the part's, so that facts meet names twice, not three times
    parts = name("target").withColumn("other", other).join(name("other"), "other", "left")
    e = stages.stored(e, "facts")
    facts = e.join(name("source"), "source").join(parts, "target")
    said = F.when(truth, F.col("target_name")).when(k == 5, "something").otherwise(F.coalesce("other_name", F.lit("nothing")))
    label = F.when(truth == (k != 1), "正确").otherwise("错误")
    altered = F.when(~truth & (k != 2), F.struct(F.col("id").alias("edge_id"), F.col("other").alias("replacement_node_id")))
    item = F.struct(
        F.concat("source_name", F.lit(" carries the "), said, F.lit(".")).alias("question"), F.array().cast("array<string>").alias("options"), label.alias("answer"), F.lit("So it is said.").alias("explanation"),
        F.array("id").alias("supporting_facts"), F.array("source").alias("referenced_entities"), F.array().cast("array<string>").alias("answer_entities"), altered.alias("altered_fact"),
    )
    rows = facts.select(F.col("id").alias("attempt"), F.to_json(item).alias("reply_json"))
    attempts = e.select(F.col("id").alias("attempt"), F.lit("true_false").alias("question_type"), truth.alias("truth"), F.array("id").alias("sub_edges"), F.array("source", "target").alias("sub_nodes"))
    return Q.validate(Q.parse_items(rows), attempts, n, e).groupBy("truth", "reason").agg(F.count("*").alias("n"))


# ---- metrics


@query("""WITH gold AS (SELECT DISTINCT l_orderkey AS pos, l_partkey AS key FROM lineitem WHERE l_quantity >= 10), pred AS (SELECT DISTINCT l_orderkey AS pos, l_partkey AS key FROM lineitem WHERE l_quantity <= 40),
c AS (SELECT count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM (SELECT coalesce(a.pos IS NOT NULL, false) AS g, coalesce(b.pos IS NOT NULL, false) AS p FROM gold a FULL JOIN pred b ON a.pos = b.pos AND a.key = b.key))
SELECT k AS kind, tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / (tp + fn)::DOUBLE, 9) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1 FROM c, (SELECT unnest(['entity', 'relation']) AS k)""")
def e1_extraction_scores(spark, sf_dir):
    """Parts of orders: those of ten pieces or more against those of forty or fewer."""
    t = table(spark, sf_dir, "lineitem")
    entity = lambda df: df.select(F.col("l_orderkey").alias("pos"), F.concat(F.lit("Part "), "l_partkey").alias("name"), F.lit("Weapon System").alias("type"))
    relation = lambda df: df.select(F.col("l_orderkey").alias("pos"), F.concat(F.lit("Part "), "l_partkey").alias("source"), F.lit("Weapon-Spec").alias("type"), F.lit("x").alias("target"))
    gold, pred = t.where("l_quantity >= 10"), t.where("l_quantity <= 40")
    out = M.extraction_scores(entity(gold), entity(pred), relation(gold), relation(pred))
    return out.select("kind", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH gold AS (SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS type, lower(trim(o_orderstatus)) AS answer FROM orders), last AS (SELECT l_orderkey::VARCHAR AS id, lower(arg_max(l_linestatus, l_extendedprice * 10 + l_linenumber)) AS answer FROM lineitem GROUP BY 1)
SELECT type, count(l.id) AS evaluated, count(*) - count(l.id) AS missing, round(coalesce(avg((g.answer = l.answer)::INT), 0), 9) AS accuracy FROM gold g LEFT JOIN last l ON l.id = g.id GROUP BY ROLLUP (type)""")
def e2_answer_scores(spark, sf_dir):
    """Orders' states against the last state of their lines."""
    none = F.lit(None).cast("array<string>").alias("answer_labels")
    gold = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("answer_text"), none)
    pred = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("answer_text"), none)
    return M.answer_scores(gold, pred).select("type", "evaluated", "missing", F.round("accuracy", 9).alias("accuracy"))


@query("SELECT answer, count(*) AS n FROM (SELECT lower(trim(c_mktsegment)) || ',' || n_name_ AS answer FROM (SELECT c_mktsegment, lower(n_name) AS n_name_ FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE lower(c_mktsegment) <= n_name_ UNION ALL SELECT n_name_ || ',' || lower(trim(c_mktsegment)) FROM (SELECT c_mktsegment, lower(n_name) AS n_name_ FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE lower(c_mktsegment) > n_name_) GROUP BY 1")
def e3_canonical_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    answer = T.canonical_answer(F.lit(None).cast("string"), F.array(F.concat(F.lit(" "), "c_mktsegment"), F.col("n_name")))
    return rows.groupBy(answer.alias("answer")).agg(F.count("*").alias("n"))
