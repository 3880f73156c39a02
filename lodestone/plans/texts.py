"""Text, markup, names, codes and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import facets as FA
from lodestone.functions import markup as M
from lodestone.functions import names as N
from lodestone.operators import terminology as T
from lodestone.plans.corpus import distance_sql, multiplier_sql
from lodestone.plans.interview import values_cte
from lodestone.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


PAGES = [
    (1, '<nav><ul><li>Home page</li></ul></nav><a href="/c/dry-eye/">Dry  <b>eye</b></a><a href="/c/dry-eye/">Again</a><h2>Symptoms of dry eye</h2><p>Symptoms include:</p><ul><li>a gritty feeling</li><li>Sore red lids</li><li>SORE RED LIDS</li><li>and</li></ul><h3>Causes of dry eye</h3><table><tr><th>Sign</th><th>Cause</th></tr><tr><td>itch</td><td>hay fever, dust or smoke</td></tr><tr><td>one</td></tr></table>'),
    (2, '<header>Top</header><a href="/c/cold/">Common cold &amp; flu</a><h2>Symptoms after a cold</h2><ul><li>a lasting cough</li></ul><h2>Check symptoms</h2><p>Runny nose at night. Sneezing a lot. Read more here</p><footer><ul><li>Contact the site</li></ul></footer>'),
    (3, '<h3>Possible causes of pain</h3><ul><li>infections like chest infection, gout - for example in toes</li><li>stress or strain</li></ul><title>A  <i>title</i></title><ref-list>none of this</ref-list><table><tr><td>x</td></tr></table>'),
    (4, None),
]
#: Every document with a condition as a page: its text under a heading, with a list and a table about causes, and furniture around it.
HEADINGS = ("Check if you have ", "Symptoms of ", "Symptoms after ")
BEFORE = '<nav><ul><li>Home page</li></ul></nav><a href="/c/{0}/">{0} &amp; more</a><h2>'
AFTER = "<h2>Causes of it</h2><ul><li>{1} or stress, flu - for example in spring</li><li>infections like {0}</li></ul><table><tr><th>Sign</th><th>Cause</th></tr><tr><td>itch</td><td>{0} or {1}</td></tr><tr><td>one</td></tr></table><footer><ul><li>Contact the site</li></ul></footer>"


def pages(spark, d):
    t = table(spark, d, "documents").filter("text IS NOT NULL AND condition IS NOT NULL")
    fill = lambda s: F.replace(F.replace(F.lit(s), F.lit("{0}"), F.col("condition")), F.lit("{1}"), F.coalesce("source", F.lit("")))
    heading = F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("doc_id") % 3 + 1).cast("int"))
    html = F.concat(fill(BEFORE), heading, F.col("condition"), F.lit("</h2>"), F.col("text"), fill(AFTER))
    return spark.createDataFrame(PAGES, "page_id bigint, html string").unionByName(t.select((F.col("doc_id") + 1000).alias("page_id"), html.alias("html")))


_FILL = lambda s: "replace(replace('" + s.replace("'", "''") + "', '{0}', condition), '{1}', coalesce(source, ''))"
P = f"WITH {values_cte('hand', 'page_id, html', PAGES)}, pg AS (SELECT page_id::BIGINT AS page_id, html FROM hand UNION ALL SELECT doc_id + 1000, {_FILL(BEFORE)} || {list(HEADINGS)}[doc_id % 3 + 1] || condition || '</h2>' || text || {_FILL(AFTER)} FROM documents WHERE text IS NOT NULL AND condition IS NOT NULL)"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain_sql(x: str) -> str:
    """The entities that the tables and the pages above hold, each written out."""
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query("html_text", f"SELECT doc_id, {plain_sql('text')} AS plain FROM documents WHERE text IS NOT NULL")
def q_html(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", M.plain(F.col("text")).alias("plain"))


@query("html_links", f"{P}, l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a href=\"/c/([^/\"]+)/\">(.*?)</a>', 1)) AS slug, unnest(regexp_extract_all(html, '(?is)<a href=\"/c/([^/\"]+)/\">(.*?)</a>', 2)) AS name, unnest(range(1, 1 + len(regexp_extract_all(html, '(?is)<a href=\"/c/([^/\"]+)/\">(.*?)</a>', 1)))) AS pos FROM pg WHERE html IS NOT NULL) SELECT slug, {plain_sql('arg_min(name, page_id * 1000 + pos)')} AS name FROM l WHERE len({plain_sql('name')}) < 90 GROUP BY 1")
def q_links(spark, d):
    """Slugs and names of index pages; of a slug the first name stays."""
    link = r'(?is)<a href="/c/([^/"]+)/">(.*?)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(link), 1).alias("slug"), F.regexp_extract_all("html", F.lit(link), 2).alias("name"))
    l = pages(spark, d).select("page_id", F.posexplode(both).alias("pos", "x")).select("page_id", "pos", "x.slug", M.plain(F.col("x.name")).alias("name"))
    return l.filter(F.length("name") < 90).groupBy("slug").agg(F.min_by("name", F.struct("page_id", "pos")).alias("name"))


_HEAD = "'(?is)^([^<]*)</h[23]>'"
SECTION = f"""{P}, pt AS (SELECT page_id, string_split_regex(html, '(?is)<h[23][^>]*>')[2:] AS parts FROM pg WHERE html IS NOT NULL), sc AS (SELECT page_id, unnest(parts) AS x, unnest(range(1, 1 + len(parts))) AS pos, len(parts) AS n FROM pt),
se AS (SELECT page_id, pos::INTEGER AS pos, CASE WHEN regexp_matches(x, {_HEAD}) THEN regexp_extract(x, {_HEAD}, 1) END AS heading, regexp_replace(x, {_HEAD}, '') AS rest, pos = n AS last FROM sc)"""
_NOT = "other condition|similar symptom|\\bafter\\b|complication|long-?term|treat|vaccin|immunis|prevent|diagnos|\\bcauses?\\b|risk|recover|living with|when to|where to|help and support"
KEPT = f"(regexp_matches(heading, '(?i)\\bsymptoms?\\b') OR regexp_matches(heading, '(?i)^\\s*check if (you|your child)')) AND NOT regexp_matches(heading, '(?i){_NOT}')"
BODY = "CASE WHEN last THEN substring(rest, 1, 6000) ELSE rest END"


def _sections(spark, d):
    return pages(spark, d).select("page_id", F.posexplode(M.sections(F.col("html"))).alias("pos", "s")).select("page_id", (F.col("pos") + 1).alias("pos"), "s.heading", "s.body")


@query("html_section", f"{SECTION} SELECT page_id, pos, heading, {BODY} AS body FROM se WHERE {KEPT}")
def q_section(spark, d):
    return _sections(spark, d).filter(M.about_symptoms(F.col("heading")))


_JUNK = "find out|read more|see a gp|call 999|call 111|ask for|go to|more in|back to|page last|next review|urgent advice|immediate action|non-urgent|information:|important:?$|get help|you can|this page|these are"
_CREDIT = "http|photo library|alamy|getty|science photo|stock photo|shutterstock|\\bDR [A-Z]|/ ?SPL\\b"


@query("html_items_clean", f"""{SECTION}, bo AS (SELECT page_id, {BODY} AS body FROM se WHERE {KEPT}), it AS (SELECT page_id, unnest(list_concat(list_transform(regexp_extract_all(body, '(?is)<li[^>]*>(.*?)</li>', 1), lambda x: {plain_sql('x')}), flatten(list_transform(regexp_extract_all(body, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: list_transform(string_split({plain_sql('x')}, '.'), lambda y: trim(y)))))) AS item FROM bo)
SELECT page_id, lower(item) AS item FROM it WHERE len(item) > 3 AND len(item) < 200 AND contains(item, ' ') AND NOT regexp_matches(item, '(?i)^({_JUNK})') AND NOT regexp_matches(item, '(?i){_CREDIT}') AND NOT regexp_matches(item, '(?i)(symptoms?|signs?)\\b.*\\b(include|are|can be|may be)\\s*:?\\s*$') GROUP BY 1, 2""")
def q_items(spark, d):
    """List items and sentences under a symptoms heading, each once whatever its case."""
    items = pages(spark, d).select("page_id", F.explode(M.section_items(F.col("html"))).alias("i"))
    return items.filter(M.is_item(F.col("i"))).select("page_id", F.lower("i").alias("item")).distinct()


_CHROME = ("nav", "header", "footer", "script", "style", "aside")


@query("html_main_items", f"{P}, m AS (SELECT page_id, " + "".join("regexp_replace(" for _ in _CHROME) + "html" + "".join(f", '(?is)<{t}\\b.*?</{t}>', ' ', 'g')" for t in _CHROME) + f" AS html FROM pg) SELECT page_id, {plain_sql('x')} AS item FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)) AS x FROM m WHERE html IS NOT NULL)")
def q_main(spark, d):
    return pages(spark, d).select("page_id", F.explode(M.elements(M.without_chrome(F.col("html")), "li")).alias("x")).select("page_id", M.plain(F.col("x")).alias("item"))


CELLS = f"{SECTION}, tb AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1)) AS t FROM pg WHERE html IS NOT NULL), rw AS (SELECT page_id, unnest(regexp_extract_all(t, '(?is)<tr[^>]*>(.*?)</tr>', 1)[2:]) AS r FROM tb), ce AS (SELECT page_id, regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1) AS c FROM rw), lc AS (SELECT page_id, {plain_sql('c[len(c)]')} AS cell FROM ce WHERE len(c) >= 2)"


@query("html_table_last_column", f"{CELLS} SELECT page_id, cell FROM lc")
def q_cells(spark, d):
    return pages(spark, d).select("page_id", F.explode(M.last_cells(F.col("html"))).alias("cell"))


_STOP = "('for example', 'smoking', 'stress', 'anxiety or stress', 'certain medicines', 'medicines', 'alcohol', 'caffeine', 'pregnancy', 'your period', 'periods', 'getting older', 'being overweight', 'dehydration')"


@query("cause_split", f"""{CELLS}, al AS (SELECT * FROM lc UNION ALL SELECT page_id, {plain_sql('x')} FROM (SELECT page_id, unnest(regexp_extract_all(CASE WHEN last THEN substring(rest, 1, 4000) ELSE rest END, '(?is)<li[^>]*>(.*?)</li>', 1)) AS x FROM se WHERE regexp_matches(heading, '(?i)causes?'))),
cs AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(unnest(string_split_regex(cell, '\\s*(?:,| or | and/or )\\s*')), '(?i)\\s*[-–—]\\s*(for example|such as|eg|e\\.g\\.).*$', ''), '^[ .–—-]+|[ .–—-]+$', '', 'g'), '(?i)^.*?\\b(?:like|such as|including)\\s+', '')) AS cause FROM al)
SELECT page_id, cause FROM cs WHERE len(cause) BETWEEN 3 AND 60 AND len(string_split_regex(cause, '\\s+')) <= 6 AND lower(cause) NOT IN {_STOP}""")
def q_causes(spark, d):
    return pages(spark, d).select("page_id", F.explode(M.page_causes(F.col("html"))).alias("cause"))


@query("xml_text", f"{P} SELECT page_id, {plain_sql(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)')} AS title, {plain_sql('regexp_replace(regexp_replace(html, ' + chr(39) + '(?is)<table.*?</table>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '(?is)<ref-list.*?</ref-list>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS body FROM pg WHERE html IS NOT NULL")
def q_xml(spark, d):
    """First element's text; the body without tables and reference lists."""
    body = F.regexp_replace(F.regexp_replace("html", "(?is)<table.*?</table>", " "), "(?is)<ref-list.*?</ref-list>", " ")
    return pages(spark, d).filter("html IS NOT NULL").select("page_id", M.plain(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), M.plain(body).alias("body"))


GUIDE = "Intro\n\n[1.1] 1.1 "


def _guides(spark, d):
    """Documents as guidelines, one paragraph under [1.1] each; of some it ends early."""
    text = F.regexp_replace("text", "\n\n+", " ")
    end = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" END more "), text)).otherwise("")
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.concat(F.lit(GUIDE), text, end, F.lit("\n\n[1.2] Nothing here.")).alias("body"))


@query("extract_block", """SELECT doc_id, trim(string_split(trim(regexp_replace('1.1 ' || t || CASE WHEN doc_id % 2 = 0 THEN ' END more ' || t ELSE '' END, '[\\s\\p{Z}]+', ' ', 'g')), 'END')[1]) AS block FROM (SELECT doc_id, regexp_replace(text, '\\n\\n+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL)""")
def q_block(spark, d):
    return _guides(spark, d).select("doc_id", M.block(F.col("body"), "1.1", "END").alias("block"))


@query("rule_template", """SELECT doc_id, 'id: "' || doc_id || '"' || chr(10) || 'text_verbatim: "' || replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' || chr(10) AS entry FROM documents WHERE text IS NOT NULL""")
def q_template(spark, d):
    """An entry of a rule file for each text, quoted."""
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", M.template("id: {id}\ntext_verbatim: {text}\n", id=F.col("doc_id").cast("string"), text=F.col("text")).alias("entry"))


@query("numbered_blocks", None)
def q_numbered(spark, d):
    """Every document as two numbered recommendations with a table of points between."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    page = F.concat(F.lit("1.1 Offer "), "text", F.lit("<table><tr><td>1.5 Points</td></tr></table> 1.2.3 (Do) "), "text")
    return t.select("doc_id", F.explode(M.numbered(page)).alias("x")).select("doc_id", "x.*")


CUES = [("view", "looked at"), ("view", "look"), ("click", "press"), ("purchase", "offered"), ("error", "worse"), ("refund", "gone")]
ADVICE = "urgent appointment"


@query("cue_coverage", f"""WITH {values_cte('cu', 'var, cue', CUES)}, dc AS (SELECT condition, lower(CASE WHEN contains(text, '{ADVICE}') THEN string_split(text, '{ADVICE}')[1] ELSE text END) AS own FROM documents WHERE condition IS NOT NULL AND text IS NOT NULL)
SELECT condition, var, count(*) AS n_documents FROM (SELECT DISTINCT condition, own, var, rn FROM (SELECT *, row_number() OVER () AS rn FROM dc) JOIN cu ON contains(own, cue)) GROUP BY 1, 2""")
def q_cues(spark, d):
    """Per condition the variables whose cues its documents hold before the first advice marker, in how many documents."""
    own = F.lower(F.substring_index("text", ADVICE, 1))
    byvar: dict[str, list[str]] = {}
    for v, c in CUES:
        byvar.setdefault(v, []).append(c)
    hits = F.array_compact(F.array(*(F.when(FA._any([own.contains(c) for c in cs]), F.lit(v)) for v, cs in byvar.items())))
    t = table(spark, d, "documents").filter("condition IS NOT NULL AND text IS NOT NULL").select("condition", F.explode(hits).alias("var"))
    return t.groupBy("condition", "var").agg(F.count(F.lit(1)).alias("n_documents"))


ASSERTED = ("view", "purchase")


@query("cue_gaps", f"""WITH {values_cte('cu', 'var, cue', CUES)}, dc AS (SELECT row_number() OVER () AS rn, condition, lower(string_split(text, '{ADVICE}')[1]) AS own, lower(substring(text, len(string_split(text, '{ADVICE}')[1]) + 1)) AS advice FROM documents WHERE condition IS NOT NULL AND text IS NOT NULL),
h AS (SELECT rn, any_value(condition) AS condition, var, bool_or(contains(own, cue)) AS o, bool_or(contains(advice, cue)) AS a FROM dc CROSS JOIN cu GROUP BY rn, var)
SELECT h.condition, var, CASE WHEN o THEN 'describes' ELSE 'red flag' END AS part, count(*) AS n_documents FROM h LEFT JOIN conditions c ON c.slug = h.condition WHERE (o OR a) AND NOT (var IN {ASSERTED} AND coalesce(c.kind = 'disorder', false)) GROUP BY 1, 2, 3""")
def q_gaps(spark, d):
    """Variables that a condition's documents mention and it doesn't assert (disorders assert two of them), before the advice or only after."""
    docs = table(spark, d, "documents").select("doc_id", "condition", "text")
    disorders = table(spark, d, "conditions").filter("kind = 'disorder'").select(F.col("slug").alias("condition"))
    asserted = disorders.select("condition", F.explode(F.array(*map(F.lit, ASSERTED))).alias("var"))
    return T.cue_gaps(docs, CUES, ADVICE, asserted)


@query("text_gate", "SELECT doc_id FROM documents WHERE contains(text, 'SNOMED')")
def q_gate(spark, d):
    return table(spark, d, "documents").filter(F.contains("text", F.lit("SNOMED"))).select("doc_id")


QUOTE = "qt AS (SELECT item_id * 100 + pos AS quote_id, trim(regexp_replace(s, '[\\s\\p{Z}]+', ' ', 'g')) AS quote FROM (SELECT item_id, unnest(string_split(text, '. ')) AS s, unnest(range(1, 1 + len(string_split(text, '. ')))) AS pos FROM eval_items WHERE text IS NOT NULL))"


@query("verbatim_quote_check", f"WITH {QUOTE} SELECT quote_id, doc_id AS text_id FROM qt JOIN (SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL) ON contains(text, quote) WHERE quote <> ''")
def q_quotes(spark, d):
    """Sentences of the held-out items that stand word for word in a document."""
    s = table(spark, d, "eval_items").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "quote"))
    quotes = s.select((F.col("item_id") * 100 + F.col("pos") + 1).alias("quote_id"), "quote")
    return T.quotes_found(quotes, table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))


NORM = "trim(regexp_replace(regexp_replace(replace(regexp_replace(lower({0}), '\\s*\\([^)]*\\)', ' ', 'g'), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("term_norm", f"SELECT DISTINCT name, {NORM.format('name')} AS norm FROM (SELECT cause_name AS name FROM presentation_causes UNION ALL SELECT name FROM presentations UNION ALL SELECT p_name FROM part) WHERE name IS NOT NULL")
def q_norm(spark, d):
    a = table(spark, d, "presentation_causes").select(F.col("cause_name").alias("name")).unionByName(table(spark, d, "presentations").select("name")).unionByName(table(spark, d, "part").select(F.col("p_name").alias("name")))
    return a.filter("name IS NOT NULL").distinct().select("name", N.norm(F.col("name")).alias("norm"))


def _variants_sql(names: str) -> str:
    """CTEs up to va (name, pos, variant): the forms of each distinct name, with lists of its own."""
    tidy = lambda l: f"list_filter({l}, lambda x, i: x IS NOT NULL AND x <> '' AND list_position({l}, x) = i)"
    n = lambda x: NORM.format(x)
    words = lambda x: f"len(string_split_regex(trim({x}), '\\s+'))"
    qualifier = "'\\s+(in adults?|in children( and young people)?|in babies|in men|in women|in pregnancy|in over \\d+s|in under \\d+s)$'"
    plurals = (("oses", "osis"), ("ses", "sis"), ("ae", "a"), ("ies", "y"), ("i", "us"), ("es", ""), ("s", ""))
    plural = "[" + ", ".join(f"CASE WHEN ends_with(x, '{e}') AND len(x) - {len(e)} >= 3 THEN " + n(f"(left(x, len(x) - {len(e)}) || '{r}')") + " END" for e, r in plurals) + "]"
    said = (("^(.*?) cancer$", "malignant neoplasm of \\1"), ("^(.*?) cancer$", "malignant tumor of \\1"), ("^broken (.*)$", "fracture of \\1"), ("^(.*?) stones?$", "calculus of \\1"), ("^(.*?) injur(?:y|ies)$", "injury of \\1"), ("^dislocated (.*)$", "dislocation of \\1"))
    rewrite = "[" + ", ".join(f"CASE WHEN regexp_matches(x, '{a}') THEN " + n(f"regexp_replace(x, '{a}', '{b}')") + " END" for a, b in said) + "]"
    bracket = f"list_filter(regexp_extract_all(body, '\\(([^)]+)\\)', 1), lambda x: {words('x')} <= 6 AND (x <> upper(x) OR NOT regexp_matches(x, '[A-Za-z]')))"
    halves = f"list_filter(string_split_regex(body, '\\s+and\\s+'), lambda x: {words('x')} >= 2)"
    return f"""nm AS ({names}), n1 AS (SELECT name, CASE WHEN contains(name, ', see ') THEN substring(name, instr(name, ', see ') + 6) ELSE name END AS body, CASE WHEN contains(name, ', see ') THEN string_split(name, ', see ')[1] END AS head FROM nm),
n2 AS (SELECT name, list_concat([{n('body')}, CASE WHEN head IS NOT NULL THEN {n('head')} END], list_transform({bracket}, lambda x: {n('x')}), [{n(f"regexp_replace({n('body')}, {qualifier}, '')")}], list_transform({halves}, lambda x: {n('x')})) AS l FROM n1),
n3 AS (SELECT name, {tidy('l')} AS l FROM n2), n4 AS (SELECT name, list_concat(l, flatten(list_transform(l, lambda x: {plural}))) AS l FROM n3), n5 AS (SELECT name, {tidy('l')} AS l FROM n4),
n6 AS (SELECT name, list_concat(l, flatten(list_transform(l, lambda x: {rewrite}))) AS l FROM n5), n7 AS (SELECT name, {tidy('l')} AS l FROM n6), va AS (SELECT name, (unnest(range(len(l))))::INTEGER AS pos, unnest(l) AS variant FROM n7)"""


_NAMES = "SELECT DISTINCT cause_name AS name FROM presentation_causes WHERE cause_name IS NOT NULL"


@query("term_variants", f"WITH {_variants_sql(_NAMES)} SELECT name, pos, variant FROM va")
def q_variants(spark, d):
    a = table(spark, d, "presentation_causes").select(F.col("cause_name").alias("name")).filter("name IS NOT NULL").distinct()
    return a.select("name", F.posexplode(N.variants(F.col("name"))).alias("pos", "variant"))


def _labels(spark, d):
    t = table(spark, d, "terms").filter("active = '1'")
    return t.select(F.col("snomed").alias("id"), F.explode(F.concat(F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("label")).filter("label IS NOT NULL")


LABELS = f"lb AS (SELECT snomed AS id, unnest(list_prepend(term, coalesce(synonyms, []))) AS label FROM terms WHERE active = '1'), ix AS (SELECT term, count(*) AS n, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM (SELECT DISTINCT {NORM.format('label')} AS term, id FROM lb WHERE label IS NOT NULL) WHERE term <> '' GROUP BY 1)"


@query("term_index", f"WITH {LABELS} SELECT * FROM ix")
def q_index(spark, d):
    return T.term_index(_labels(spark, d))


@query("label_exact_match", f"WITH {LABELS} SELECT DISTINCT cause_name AS name, ix.id FROM presentation_causes JOIN ix ON ix.term = {NORM.format('cause_name')} WHERE ix.n = 1")
def q_exact(spark, d):
    names = table(spark, d, "presentation_causes").filter("cause_name IS NOT NULL").select(F.col("cause_name").alias("name")).distinct()
    ix = T.term_index(_labels(spark, d)).filter("n = 1")
    return names.withColumn("term", N.norm(F.col("name"))).join(ix, "term").select("name", "id")


MATCHED = f"""WITH {LABELS}, {_variants_sql(_NAMES)}, hi AS (SELECT name, pos, variant, n, id FROM va JOIN ix ON ix.term = variant), be AS (SELECT name, arg_min(id, pos) AS id, arg_min(variant, pos) AS variant FROM hi WHERE n = 1 GROUP BY 1),
ma AS (SELECT nm.name, be.id, be.variant, be.name IS NULL AND nm.name IN (SELECT name FROM hi) AS ambiguous FROM nm LEFT JOIN be USING (name))"""


@query("term_match", f"{MATCHED} SELECT * FROM ma")
def q_match(spark, d):
    return T.term_match(table(spark, d, "presentation_causes").select(F.col("cause_name").alias("name")), T.term_index(_labels(spark, d)))


@query("term_match_fallback", f"{MATCHED}, bk AS (SELECT {NORM.format('name')} AS term, min(snomed) AS backup FROM conditions WHERE snomed IS NOT NULL GROUP BY 1) SELECT name, coalesce(id, backup) AS id, CASE WHEN id IS NOT NULL THEN 'term' WHEN backup IS NOT NULL THEN 'backup' END AS origin FROM ma LEFT JOIN bk ON bk.term = {NORM.format('ma.name')}")
def q_fallback(spark, d):
    """Names of conditions are the backup for those the terms don't know."""
    backup = table(spark, d, "conditions").filter("snomed IS NOT NULL").groupBy(N.norm(F.col("name")).alias("term")).agg(F.min("snomed").alias("id"))
    return T.with_fallback(QUERIES["term_match"](spark, d), backup)


@query("first_label_per_key", "SELECT t.snomed AS id, t.synonyms[1] AS label FROM terms t WHERE len(t.synonyms) > 0 AND t.snomed IN (SELECT snomed FROM conditions) AND t.synonyms[1] IS NOT NULL")
def q_first(spark, d):
    """The first synonym of each term that is a condition's."""
    l = table(spark, d, "terms").select(F.col("snomed").alias("id"), F.posexplode("synonyms").alias("ord", "label"))
    return T.first_label(l, table(spark, d, "conditions").select(F.col("snomed").alias("id")))


TARGETS = [("U", "U77"), ("U", "U27.0"), ("U", "U45.85"), ("V", "V1")]


@query("code_crosswalk", f"""WITH {values_cte('tg', 'key, target', TARGETS)}, ou AS (SELECT slug, substring(icd10, 1, 1) AS key, icd10 AS code FROM conditions WHERE icd10 IS NOT NULL)
SELECT slug AS key, code, ['NO MAP', 'MISMATCH', 'NEARBY', 'NARROWER', 'EXACT'][1 + max(CASE WHEN target IS NULL THEN 0 WHEN replace(code, '.', '') = replace(target, '.', '') THEN 4 WHEN starts_with(replace(code, '.', ''), replace(target, '.', '')) THEN 3 WHEN substring(replace(code, '.', ''), 1, 3) = substring(replace(target, '.', ''), 1, 3) THEN 2 ELSE 1 END)] AS class FROM ou LEFT JOIN tg USING (key) GROUP BY slug, code""")
def q_crosswalk(spark, d):
    """Every condition's code against the mapped targets of its chapter."""
    ours = table(spark, d, "conditions").filter("icd10 IS NOT NULL").select(F.col("slug").alias("key"), F.col("icd10").alias("code"))
    t = spark.createDataFrame(TARGETS, "chapter string, target string")
    targets = ours.select("key", F.substring("code", 1, 1).alias("chapter")).join(F.broadcast(t), "chapter").select("key", "target")
    return T.crosswalk(ours, targets)


BANDS = [("duration", a, b) for a in [*FA.DURATIONS, "unspecified"] for b in [*FA.DURATIONS, "unspecified", None]] + [("onset", a, b) for a in [*FA.ONSETS, "unspecified"] for b in [*FA.ONSETS, "unspecified", None]]


@query("band_distance", f"WITH {values_cte('bd', 'scale, a, b', BANDS)} SELECT scale, a, b, CASE WHEN scale = 'duration' THEN {distance_sql('a', 'b', FA.DURATIONS)} ELSE {distance_sql('a', 'b', FA.ONSETS)} END AS distance FROM bd")
def q_bands(spark, d):
    g = spark.createDataFrame(BANDS, "scale string, a string, b string")
    a, b = F.col("a"), F.col("b")
    return g.select("scale", "a", "b", F.when(F.col("scale") == "duration", FA.band_distance(a, b, FA.DURATIONS)).otherwise(FA.band_distance(a, b, FA.ONSETS)).alias("distance"))


@query("facet_multiplier", f"SELECT DISTINCT l.onset, l.duration, m.onset AS p_onset, m.duration AS p_duration, round({multiplier_sql('l.onset', 'l.duration', 'm.onset', 'm.duration')}, 9) AS multiplier FROM (SELECT DISTINCT onset, duration FROM links) l CROSS JOIN (SELECT DISTINCT record.onset AS onset, record.duration AS duration FROM symptom_matches) m")
def q_multiplier(spark, d):
    """Every pair of facets that links and records hold; both are bounded by the bands."""
    l = table(spark, d, "links").select("onset", "duration").distinct()
    m = table(spark, d, "symptom_matches").select(F.col("record.onset").alias("p_onset"), F.col("record.duration").alias("p_duration")).distinct()
    return l.join(F.broadcast(m)).select("*", F.round(FA.facet_multiplier(F.col("onset"), F.col("duration"), F.col("p_onset"), F.col("p_duration")), 9).alias("multiplier"))


FIELDS = ("concept", "character", "site", "onset", "duration", "duration_text", "severity", "progression", "polarity")
DEFAULTS = {"onset": "unspecified", "duration": "unspecified", "severity": "unspecified", "progression": "unspecified", "polarity": "present"}


def _records(spark, d):
    r = F.from_json("json", ", ".join(f"`{f}` string" for f in FIELDS) + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    t = table(spark, d, "raw_records").filter("json IS NOT NULL").select("raw_id", r.alias("r")).filter("r._bad IS NULL AND r IS NOT NULL")
    return t.select("raw_id", *(tidy_record(f).alias(f) for f in FIELDS))


def tidy_record(f: str):
    """A field of the record `r`, trimmed, the nouns in lower case, with its default where it is null or blank."""
    v = F.trim(F.lower(f"r.{f}")) if f in ("concept", "character", "site") else F.trim(f"r.{f}")
    return F.coalesce(F.nullif(v, F.lit("")), F.lit(DEFAULTS.get(f, "")))


def _record_sql(f: str) -> str:
    x = f"json_extract_string(json, '$.{f}')"
    x = f"lower({x})" if f in ("concept", "character", "site") else x
    return f"coalesce(nullif(trim({x}), ''), '{DEFAULTS.get(f, '')}') AS {f}"


RECORDS = "rc AS (SELECT raw_id, " + ", ".join(map(_record_sql, FIELDS)) + " FROM (SELECT raw_id, CASE WHEN json_valid(json) THEN json END AS json FROM raw_records) WHERE json IS NOT NULL)"


@query("record_defaults", f"WITH {RECORDS} SELECT * FROM rc")
def q_defaults(spark, d):
    return _records(spark, d)


_ID_RECORDS = f"rc AS (SELECT raw_id AS id, {', '.join(map(_record_sql, FIELDS))} FROM (SELECT raw_id, CASE WHEN json_valid(json) THEN json END AS json FROM raw_records) WHERE json IS NOT NULL)"


@query("record_arrays", f"WITH {_ID_RECORDS} SELECT * FROM rc")
def q_arrays(spark, d):
    """Records with ids out of a reply {"records": [...]}; here each valid object is put into one with its raw_id."""
    ok = table(spark, d, "raw_records").filter(F.get_json_object("json", "$").isNotNull() & F.col("json").startswith("{"))
    reply = ok.select(F.concat(F.lit('{"records": [{"id": '), F.col("raw_id").cast("string"), F.when(F.length(F.trim(F.substring("json", 2, 1_000_000))) > 1, ", ").otherwise(""), F.substring("json", 2, 1_000_000), F.lit("]}")).alias("json"))
    item = ", ".join(f"`{f}`: string" for f in FIELDS)
    r = reply.select(F.explode(F.from_json("json", f"records array<struct<id: bigint, {item}>>")["records"]).alias("r")).filter("r.id IS NOT NULL")
    return r.select("r.id", *(tidy_record(f).alias(f) for f in FIELDS))


def _faults_sql() -> str:
    out = [(f, f"{f} NOT IN {tuple([*o, 'unspecified'])}") for f, o in (("onset", FA.ONSETS), ("duration", FA.DURATIONS), ("severity", FA.SEVERITIES), ("progression", FA.PROGRESSIONS))]
    out.append(("polarity", f"polarity NOT IN {tuple(FA.POLARITIES)}"))
    for s in ("concept", "character", "site"):
        out += [(f"{s}_case", f"{s} <> lower({s})"), (f"{s}_bundle", " OR ".join(f"contains(' ' || {s} || ' ', '{b}')" for b in FA.BANNED))]
    n = "len(regexp_extract_all({0}, '\\S+'))"
    out += [("concept_missing", "concept = ''"), ("concept_long", n.format("concept") + " > 2"), ("character_long", n.format("character") + " > 1"), ("site_long", n.format("site") + " > 2")]
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in out) + "], lambda x: x IS NOT NULL)"


@query("record_contract", f"WITH {RECORDS} SELECT raw_id, array_to_string({_faults_sql()}, ',') AS faults FROM rc WHERE len({_faults_sql()}) > 0")
def q_contract(spark, d):
    r = _records(spark, d)
    return r.select("raw_id", FA.record_faults({f: F.col(f) for f in FIELDS}).alias("f")).filter(F.size("f") > 0).select("raw_id", F.array_join("f", ",").alias("faults"))


@query("core_phrase", f"WITH {RECORDS} SELECT raw_id, CASE WHEN character <> '' THEN character || ' ' ELSE '' END || concept || CASE WHEN site <> '' THEN ' in the ' || site ELSE '' END AS phrase FROM rc WHERE concept <> ''")
def q_core(spark, d):
    return _records(spark, d).filter("concept <> ''").select("raw_id", FA.core_phrase(F.col("concept"), F.col("character"), F.col("site")).alias("phrase"))


@query("content_digest", "SELECT count(*) AS n_rows, sha256(count(*) || ':' || coalesce(sum(('0x' || substring(sha256(symptom_id || ':' || core_phrase), 1, 15))::BIGINT::HUGEINT), 0)) AS digest FROM symptoms_v2 WHERE core_phrase IS NOT NULL")
def q_digest(spark, d):
    return T.content_digest(table(spark, d, "symptoms_v2"), "core_phrase", "symptom_id")


@query("cache_miss_antijoin", "SELECT DISTINCT sha256('m:64:' || core_phrase) AS key, core_phrase AS text FROM symptoms_v2 WHERE core_phrase IS NOT NULL AND core_phrase NOT IN (SELECT phrase FROM symptom_vectors WHERE phrase IS NOT NULL)")
def q_misses(spark, d):
    """Phrases of the vocabulary that have no vector yet."""
    wanted, cached = table(spark, d, "symptoms_v2").select(F.col("core_phrase").alias("text")), table(spark, d, "symptom_vectors").select(F.col("phrase").alias("text"))
    return T.cache_misses(wanted, cached, "m", 64)
