"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SENTIMENT_SEVERITY, SENTIMENT_TONE
from ..functions import text as T
from ..operators import feeds
from ..sources.views import table
from .registry import query

_ANY = lambda words: " OR ".join(f"contains(low, '{w}')" for w in words)
_CASES = lambda rules, other: "CASE " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in rules) + f" ELSE '{other}' END"


@query("sentiment_lexicon", f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), s AS (SELECT doc_id, {_CASES([(_ANY(w), k) for k, w in T.LEXICON.items()], T.NO_TIER)} AS sentiment FROM t)
SELECT doc_id, sentiment, CASE sentiment """ + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SENTIMENT_SEVERITY.items()) + " END AS severity, CASE sentiment " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SENTIMENT_TONE.items()) + " END AS tone FROM s")  # fmt: skip
def sentiment_lexicon(spark, sf_dir):
    look = lambda m: F.coalesce(*[F.when(F.col("sentiment") == k, F.lit(v)) for k, v in m.items()])
    return table(spark, sf_dir, "documents").select("doc_id", T.sentiment(F.col("text")).alias("sentiment")).select("doc_id", "sentiment", look(SENTIMENT_SEVERITY).alias("severity"), look(SENTIMENT_TONE).alias("tone"))


@query("actor_action", f"""WITH t AS (SELECT doc_id, lower(trim(split_part(coalesce(text, ''), '.', 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS low FROM documents)
SELECT doc_id, {_CASES([(_ANY([a.lower()]), a) for a in T.ACTORS], T.NO_ACTOR)} AS actor, {_CASES([(_ANY([k]), v) for k, v in T.ACTIONS.items()], T.NO_ACTION)} AS action FROM t""")  # fmt: skip
def actor_action(spark, sf_dir):
    s = T.before_stop(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.actor(s).alias("actor"), T.action(s).alias("action"))


@query("entity_alias_scan", "WITH a(alias, entity) AS (VALUES ('license', 'LICENCE'), ('apache', 'APACHE'), ('reserved', 'RIGHTS'), ('example.com', 'EXAMPLE'), ('cc by', 'CC'), ('no', 'SHORT')) SELECT doc_id, entity FROM documents JOIN a ON length(alias) >= 3 AND contains(lower(text), alias)")
def entity_alias_scan(spark, sf_dir):
    """Aliases of three letters and more in texts; the registry's alias list is fixed, so it is broadcast."""
    a = spark.createDataFrame([("license", "LICENCE"), ("apache", "APACHE"), ("reserved", "RIGHTS"), ("example.com", "EXAMPLE"), ("cc by", "CC"), ("no", "SHORT")], "alias string, entity string").where("length(alias) >= 3")
    return table(spark, sf_dir, "documents").join(F.broadcast(a), F.contains(F.lower("text"), F.col("alias"))).select("doc_id", "entity")


@query("alias_lookup", "WITH a AS (SELECT lower(trim(n_name)) AS alias, n_nationkey AS id FROM nation UNION ALL SELECT 'n' || n_nationkey, n_nationkey FROM nation), q AS (SELECT c_custkey, 'N' || (c_custkey % 30) || ' ' AS word FROM customer) SELECT c_custkey, id FROM q LEFT JOIN a ON alias = lower(trim(word))")
def alias_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a = n.select(F.lower(F.trim("n_name")).alias("alias"), F.col("n_nationkey").alias("id")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("alias"), F.col("n_nationkey").alias("id")))
    q = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("N"), (F.col("c_custkey") % 30).cast("string"), F.lit(" ")).alias("word"))
    return q.join(a, F.lower(F.trim("word")) == F.col("alias"), "left").select("c_custkey", "id")


@query("feed_dedup", "WITH f AS (SELECT doc_id, lower(trim(substr(text, 1, 80))) AS k, n_chars FROM documents) SELECT min(doc_id) AS doc_id, count(*) AS copies FROM f GROUP BY k")
def feed_dedup(spark, sf_dir):
    """One item a headline key; the key of a feed is the first 80 characters."""
    return feeds.dedup(table(spark, sf_dir, "documents"), F.lower(F.trim(F.left("text", F.lit(80)))), "doc_id").select("doc_id", "copies")


@query("recent_intelligence", "WITH f AS (SELECT *, lower(trim(substr(text, 1, 80))) AS k FROM (SELECT * FROM documents ORDER BY doc_id DESC LIMIT 120)), d AS (SELECT max(doc_id) AS doc_id FROM f GROUP BY k) SELECT doc_id FROM d ORDER BY doc_id DESC LIMIT 20")
def recent_intelligence(spark, sf_dir):
    """The newest 120 items, one of each headline, of these 20: a feed is a top list."""
    new = table(spark, sf_dir, "documents").orderBy(F.desc("doc_id")).limit(120)
    return new.groupBy(F.lower(F.trim(F.left("text", F.lit(80)))).alias("k")).agg(F.max("doc_id").alias("doc_id")).select("doc_id").orderBy(F.desc("doc_id")).limit(20)


@query("evidence", "SELECT source AS entity, doc_id, length(text) AS size FROM documents JOIN labels USING (doc_id) WHERE quality = 1 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 5")
def evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return feeds.newest(d.select(F.col("source").alias("entity"), "doc_id", F.length("text").cast("long").alias("size")), "entity", "doc_id", 5)


@query("headline", r"""WITH b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\[\[([^\]|]*)(\|[^\]]*)?\]\]', '\1', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, left(CASE WHEN regexp_extract(t, '^([^.!?\n]*[.!?])(\s|$)', 1) <> '' THEN regexp_extract(t, '^([^.!?\n]*[.!?])(\s|$)', 1) ELSE t END, 160) AS headline FROM b""")  # fmt: skip
def headline(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.headline(F.col("text")).alias("headline"))


@query("wikilinks", r"WITH d AS (SELECT doc_id, 'see [[' || source || ']] and [[' || lang || '|x]] and [[' || source || ']] ' || text AS t FROM documents) SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, '\[\[([^\]|]+)', 1))) AS link FROM d")
def wikilinks(spark, sf_dir):
    t = F.concat(F.lit("see [["), "source", F.lit("]] and [["), "lang", F.lit("|x]] and [["), "source", F.lit("]] "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.links(t)).alias("link"))


@query("speech", r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```[^`]*```', ' ', 'g'), '(?m)^\s*\|.*$', ' ', 'g'), '(?m)^\s*[-*#]+\s+', '', 'g'), '\*\*|__|`|\[[0-9]+\]', '', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, left(trim(CASE WHEN regexp_extract(t, '^([^.!?]*[.!?]+ ?[^.!?]*[.!?]+)', 1) <> '' THEN regexp_extract(t, '^([^.!?]*[.!?]+ ?[^.!?]*[.!?]+)', 1) ELSE t END), 320) AS said FROM t""")  # fmt: skip
def speech(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.speakable(F.col("text")).alias("said"))


@query("html_strip", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n\x0b\x0c]+', ' ', 'g')) AS text FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


_WORDS = "len(list_filter(regexp_split_to_array({}, '[ \\t\\r\\n\\x0b\\x0c]+'), lambda w: w <> ''))"


@query("copilot_route", f"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{T.REASONING}') OR {_WORDS.format('text')} > 12 THEN 'graph' ELSE 'vector' END AS route FROM conversations WHERE role = 'user'")
def copilot_route(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.route(F.col("text")).alias("route"))


#: Stand-ins for the registry, of the syllables of the invented conversations.
_NAMES = {"thewh": "Thewh", "the": "The", "ander": "Ander", "que": "Que", "ment": "Ment", "der": "Der"}
_SPOKEN = """h AS (SELECT conv_id, turn, text, rtrim(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '.,!?') AS heard FROM conversations WHERE role = 'user'),
m AS (SELECT conv_id, turn, name, ord, CASE WHEN heard = alias THEN 1000000 WHEN contains(heard, alias) OR contains(alias, heard) THEN least(length(heard), length(alias)) ELSE 0 END AS s FROM h, (VALUES """ + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(_NAMES.items())) + """) e(alias, name, ord) WHERE heard <> ''),
e AS (SELECT conv_id, turn, arg_max(name, (s, -ord)) FILTER (s > 0) AS entity FROM m GROUP BY 1, 2)"""  # fmt: skip


@query("voice_entity", f"WITH {_SPOKEN} SELECT conv_id, turn, entity FROM h LEFT JOIN e USING (conv_id, turn)")
def voice_entity(spark, sf_dir):
    """An alias that is the utterance, else the longest overlap by containment, else the first in the list."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.spoken_entity(F.col("text"), _NAMES).alias("entity"))


@query("voice_intent", f"""WITH {_SPOKEN},
t AS (SELECT conv_id, turn, entity, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM h LEFT JOIN e USING (conv_id, turn)),
l AS (SELECT *, lower(t) AS low, coalesce(entity, list_last(list_filter(regexp_split_to_array(t, '[ \\t\\r\\n\\x0b\\x0c]+'), lambda w: w <> ''))) AS chosen FROM t),
k AS (SELECT *, CASE WHEN t = '' OR regexp_matches(low, '{T.STOP}') THEN 'stop' WHEN regexp_matches(low, '{T.RUN}') AND entity IS NOT NULL THEN 'run_scenario' WHEN regexp_matches(low, '{T.WIKI}') AND entity IS NOT NULL THEN 'open_wiki'
  WHEN regexp_matches(low, '{T.FOCUS}') AND entity IS NOT NULL THEN 'focus_entity' WHEN regexp_matches(low, '{"|".join(p for p, _ in T.FIGURES)}') THEN 'flash_kpi' WHEN regexp_matches(low, '{"|".join(p for p, _ in T.VIEWS)}') THEN 'navigate'
  WHEN regexp_matches(low, '{T.SELECT}') THEN 'select_option' ELSE 'none' END AS kind FROM l)
SELECT conv_id, turn, CASE WHEN kind NOT IN ('stop', 'none') THEN kind END AS type,
  CASE kind WHEN 'run_scenario' THEN entity WHEN 'open_wiki' THEN entity WHEN 'focus_entity' THEN entity WHEN 'select_option' THEN chosen
    WHEN 'flash_kpi' THEN CASE {" ".join(f"WHEN regexp_matches(low, '{p}') THEN '{v}'" for p, v in T.FIGURES)} END
    WHEN 'navigate' THEN CASE {" ".join(f"WHEN regexp_matches(low, '{p}') THEN '{v}'" for p, v in T.VIEWS)} END END AS target,
  CASE kind WHEN 'run_scenario' THEN 'Running the ' || entity || ' scenario.' WHEN 'focus_entity' THEN 'Here''s ' || entity || '.' WHEN 'select_option' THEN 'Selecting ' || chosen || '.'
    WHEN 'navigate' THEN CASE {" ".join(f"WHEN regexp_matches(low, '{p}') THEN '{T.VIEW_REPLIES[v]}'" for p, v in T.VIEWS)} END END AS said,
  CASE kind WHEN 'open_wiki' THEN TRUE WHEN 'none' THEN regexp_matches(low, '{T.QUESTION}') OR {_WORDS.format('t')} > 4 ELSE FALSE END AS is_query FROM k""")  # fmt: skip
def voice_intent(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.command(text, T.spoken_entity(text, _NAMES)).alias("c")).select("conv_id", "turn", "c.*")


@query("scalar_json", """SELECT doc_id, source AS k, n_chars AS v, to_json({'entity': source, 'value': n_chars}) AS dumped FROM documents""")
def scalar_json(spark, sf_dir):
    """A JSON object cut out of the prose around it and parsed; rows written as JSON."""
    d = table(spark, sf_dir, "documents")
    said = F.concat(F.lit("Here it is: {\"k\": \""), "source", F.lit("\",\n \"v\": "), F.col("n_chars").cast("string"), F.lit("} - done."))
    got = F.from_json(T.json_part(said), "k string, v long")
    return d.select("doc_id", got["k"].alias("k"), got["v"].alias("v"), F.to_json(F.struct(F.col("source").alias("entity"), F.col("n_chars").alias("value"))).alias("dumped"))


@query("situation_brief", """WITH s AS (SELECT doc_id, lang, round(quality * 6 + CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END + least(n_chars, 4000) / 800 + 0.3::DOUBLE * (doc_id % 10) / 10, 6) AS score FROM documents JOIN labels USING (doc_id))
SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 12""")  # fmt: skip
def situation_brief(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    score = F.col("quality") * 6 + F.when(F.col("lang") == "en", 2).when(F.col("lang") == "fr", 1).otherwise(0) + F.least("n_chars", F.lit(4000)) / 800 + 0.3 * (F.col("doc_id") % 10) / 10
    return d.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(12)


@query("intel_clean", r"SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'synthesis' ELSE coalesce(nullif(regexp_extract('source=' || source || ';', 'source=([A-Za-z0-9_]+)', 1), ''), 'text') END AS origin, coalesce(nullif(regexp_extract(text, '(https?://[^\s]+)', 1), ''), 'about:' || source) AS url FROM documents WHERE NOT contains(lower(text), 'license') AND NOT starts_with(text, 'The ')")
def intel_clean(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(~F.contains(F.lower("text"), F.lit("license")) & ~F.startswith("text", F.lit("The ")))
    named = F.coalesce(F.nullif(F.regexp_extract(F.concat(F.lit("source="), "source", F.lit(";")), "source=([A-Za-z0-9_]+)", 1), F.lit("")), F.lit("text"))
    return d.select("doc_id", F.when(F.col("source").isin("src0", "src1"), "synthesis").otherwise(named).alias("origin"), F.coalesce(F.nullif(F.regexp_extract("text", r"(https?://[^\s]+)", 1), F.lit("")), F.concat(F.lit("about:"), "source")).alias("url"))


@query("page_validate", """WITH p AS (SELECT doc_id, n_chars >= 200 AS a, contains(text, '. ') AS b, source <> 'src3' AS c FROM documents)
SELECT doc_id, unnest(list_filter([CASE WHEN NOT a THEN 'short' END, CASE WHEN NOT b THEN 'no sentence' END, CASE WHEN NOT c THEN 'bad source' END], lambda x: x IS NOT NULL)) AS problem FROM p""")  # fmt: skip
def page_validate(spark, sf_dir):
    checks = F.array(F.when(F.col("n_chars") < 200, "short"), F.when(~F.contains("text", F.lit(". ")), "no sentence"), F.when(F.col("source") == "src3", "bad source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))


@query("feed_union", "SELECT 'doc' AS feed, doc_id AS id, lang AS tag FROM documents UNION SELECT 'page', page_id, split_part(url, '/', 3) FROM pages UNION SELECT 'talk', conv_id, role FROM conversations")
def feed_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("doc").alias("feed"), F.col("doc_id").alias("id"), F.col("lang").alias("tag"))
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("feed"), F.col("page_id").alias("id"), F.split_part("url", F.lit("/"), F.lit(3)).alias("tag"))
    c = table(spark, sf_dir, "conversations").select(F.lit("talk").alias("feed"), F.col("conv_id").alias("id"), F.col("role").alias("tag"))
    return d.unionByName(p).unionByName(c).distinct()


@query("scalar_text", r"""SELECT doc_id, replace(replace(lower(source || ' ' || lang || '/x'), ' ', '_'), '/', '-') AS slug, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS preset, coalesce(nullif(n_chars % 7, 0), 99) AS v FROM documents""")
def scalar_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.concat("source", F.lit(" "), "lang", F.lit("/x"))).alias("slug"), T.preset_slug(F.col("text")).alias("preset"), F.coalesce(F.nullif(F.col("n_chars") % 7, F.lit(0)), F.lit(99)).cast("long").alias("v"))


@query("sanctions_parse", "SELECT * FROM (VALUES (36::BIGINT, 'OCEAN STAR', 'vessel', '123456789', 'IRAN'), (37, 'John Q Public', 'person', NULL, 'SDGT'), (38, 'Acme Shipping', 'entity', NULL, 'IRAN')) t(uid, name, kind, mmsi, program)")
def sanctions_parse(spark, sf_dir):
    """A list in XML, given as text, parsed without a file."""
    from ..sources.feeds import parse_sanctions

    xml = """<list><sdnEntry><uid>36</uid><lastName>OCEAN STAR</lastName><sdnType>Vessel</sdnType><program>IRAN</program><remarks>MMSI 123456789</remarks></sdnEntry>
    <sdnEntry><uid>37</uid><firstName>John Q</firstName><lastName>Public</lastName><sdnType>Individual</sdnType><program>SDGT</program></sdnEntry>
    <sdnEntry><uid>38</uid><lastName>Acme Shipping</lastName><sdnType>Entity</sdnType><program>IRAN</program></sdnEntry></list>"""
    return parse_sanctions(spark.createDataFrame([(xml,)], "xml string")).select("uid", "name", "kind", "mmsi", "program")
