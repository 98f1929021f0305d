"""Queries of the text operators, on documents and pages and on small inline fixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import display, gazetteer, grammar, tables, text
from factloom.operators import relations, spans
from factloom.plans import adapters as ad
from factloom.plans.catalogue import query


def _docs(s, d):
    return ad.table(s, d, "documents")


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text,'\n'), lambda x: trim(x)<>'')) AS BIGINT) AS lines, md5(lower(trim(regexp_replace(regexp_replace(text,'[0-9]+','','g'),'\s+',' ','g')))) AS key FROM documents", plain=True)
def text_clean(s, d):
    """X04"""
    lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")).cast("long")
    return _docs(s, d).select("doc_id", lines.alias("lines"), F.md5(text.normal_line(F.col("text")).cast("binary")).alias("key"))


@query("SELECT doc_id, CASE WHEN c+l>0 THEN round(c/(c+l),4) END AS share FROM (SELECT doc_id, len(regexp_extract_all(substr(text,1,4000),'[а-яёА-ЯЁ]')) AS c, len(regexp_extract_all(substr(text,1,4000),'[a-zA-Z]')) AS l FROM documents)", plain=True)
def language_ratio(s, d):
    """M10 M11 H01"""
    return _docs(s, d).select("doc_id", F.round(text.cyrillic_share(F.col("text")), 4).alias("share"))


@query("""SELECT page_id AS doc_id, CAST(arg_max(y, (n, y)) AS INTEGER) AS year FROM (SELECT page_id, y, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(' ' || replace(replace(substr(url || ' 1999/2001/2001/1987',1,3000),'/',' /'),'.',' .') || ' ', '[^0-9]((?:19|20)[0-9][0-9])(?:[^0-9])', 1)) AS y FROM pages) GROUP BY 1,2) GROUP BY 1""", plain=True, fixture=True)
def year_mode(s, d):
    """A21"""
    rows = ad.table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.regexp_replace(F.regexp_replace("url", "/", " /"), "\\.", " ."), F.lit(" 1999 /2001 /2001 /1987")).alias("text"))
    return text.year_modes(rows)


@query(r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text,chr(10))) AS line FROM conversations), k AS (SELECT *, lower(trim(regexp_replace(regexp_replace(line,'[0-9]+','','g'),'\s+',' ','g'))) AS key FROM l),
n AS (SELECT conv_id, count(DISTINCT turn) AS p FROM k GROUP BY 1), o AS (SELECT conv_id, key FROM k JOIN n USING (conv_id) WHERE key<>'' GROUP BY conv_id, key, p HAVING count(DISTINCT turn)>=greatest(2, ceil(0.3*p)))
SELECT conv_id AS doc_id, count(*) AS kept FROM k WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.conv_id=k.conv_id AND o.key=k.key) AND NOT regexp_full_match(line,'\s*[0-9]{1,4}\s*') GROUP BY 1""", plain=True)
def repeated_lines(s, d):
    """Lines that stand on many pages go"""
    rows = ad.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return text.without_running_lines(rows).groupBy("doc_id").agg(F.count("*").alias("kept"))


_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text,''), '([.!?;])[\s\v]+([\p{Lu}\d])', '\1' || chr(1) || '\2', 'g'), '\n[\s\v]*\n', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) BETWEEN 12 AND 1200)"""


@query(f"SELECT doc_id, CAST(i-1 AS INTEGER) AS sent_no, s[i] AS sent FROM (SELECT doc_id, s, unnest(range(1, len(s)+1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents))", plain=True)
def sentence_split(s, d):
    """X08 F30 D4"""
    return text.sentence_rows(_docs(s, d))


@query()
def chunk_pack(s, d):
    """W14 L07"""
    return _docs(s, d).select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk_no", "chunk"))


FIXTURE_SENTENCES = [
    (1, "рынок меди: рост на 10,1 % к 2011 г.", "market"),
    (2, "12 % 15 мм 18 мм 20 кг ", "garble"),
    (3, "медь никель кобальт", "no_verb"),
    (4, "извлечение никеля составляет 95 %", None),
]


@query("SELECT * FROM (VALUES (1,'market'),(2,'garble'),(3,'no_verb'),(4,NULL)) t(id, reason)", plain=True, fixture=True)
def noise_classify(s, d):
    """F19 H07"""
    rows = s.createDataFrame([x[:2] for x in FIXTURE_SENTENCES], "id int, sent string")
    return rows.select("id", text.noise(F.col("sent")).alias("reason"))


GOLDEN = [
    (1, "концентрация меди не менее 12,5 г/л"),
    (2, "при pH > 10 осаждается"),
    (3, "выдержка от 60 до 80 °C"),
    (4, "нагрели до 90 °C"),
    (5, "извлечение 5–3 %"),
    (6, "Fe 15 ppm в твёрдом остатке"),
    (7, "длина 5 м"),
]


@query(
    """SELECT * FROM (VALUES (1,'концентрация','медь',12500.0::DOUBLE,NULL::DOUBLE,'>=','mg_L',1.0::DOUBLE),(2,'pH',NULL,10.0,NULL,'>','pH',1.0),(3,'температура',NULL,60.0,80.0,'=','degC',1.0),
  (4,'температура',NULL,90.0,90.0,'=','degC',1.0),(5,'извлечение',NULL,5.0,3.0,'=','pct',0.5),(6,NULL,'железо',15.0,15.0,'=','ppm',0.6)) t(id,metric,material,value_low,value_high,comparator,unit_canon,confidence)""",
    plain=True,
    fixture=True,
)
def grammar_golden(s, d):
    """E01-E09 M01 M02"""
    rows = s.createDataFrame(GOLDEN, "id int, sent string")
    v = rows.select("id", F.explode(grammar.values_udf()("sent")).alias("v"))
    return v.select("id", *[F.col(f"v.{c}").alias(c) for c in ("metric", "material", "value_low", "value_high", "comparator", "unit_canon", "confidence")])


ENTRIES = gazetteer.checked(
    [
        {"type": "Material", "canon": "медь", "aliases": ["медь"], "aliases_en": ["copper"], "symbols": ["Cu"]},
        {"type": "Material", "canon": "сера", "aliases": ["сера"], "symbols_guarded": ["S"]},
        {"type": "Process", "canon": "электроэкстракция", "aliases": ["электроэкстракция"], "aliases_en": ["electrowinning"]},
        {"type": "Facility", "canon": "Надежда", "aliases": ["Надежда"]},
    ]
)


@query("SELECT * FROM (VALUES (1,'медь','Material','меди'),(1,'электроэкстракция','Process','электроэкстракции'),(2,'медь','Material','copper'),(2,'электроэкстракция','Process','electrowinning'),(3,'медь','Material','Cu'),(3,'сера','Material','S'),(5,'Надежда','Facility','Надежда')) t(id,canon,type,form)", plain=True, fixture=True)
def gazetteer_golden(s, d):
    """E10 S14 H09 H10"""
    rows = s.createDataFrame([(1, "католит меди при электроэкстракции"), (2, "copper electrowinning"), (3, "Cu, S и 5 %"), (4, "Дело S и Надежда"), (5, "завод Надежда")], "id int, sent string")
    m = rows.select("id", F.explode(gazetteer.mentions_udf(ENTRIES)("sent")).alias("m"))
    return m.select("id", "m.canon", "m.type", "m.form")


GRID = [("d", 1, r, c, t) for r, row in enumerate([["Продукт", "Cu", "Ni", "Fe", "S"], ["Штейн", "45,5", "20-25", "<3", "24"], ["Шлак", "0,6", "", "38", "1999"], ["Итого", "1", "2", "3", "4"]]) for c, t in enumerate(row)]


@query("SELECT * FROM (VALUES ('Cu','=',45.5::DOUBLE,45.5::DOUBLE,'штейн'),('Ni','=',20.0,25.0,'штейн'),('Fe','<',NULL,3.0,'штейн'),('S','=',24.0,24.0,'штейн'),('Cu','=',0.6,0.6,'шлак'),('Fe','=',38.0,38.0,'шлак')) t(canon,comparator,value_low,value_high,phase)", plain=True, fixture=True)
def grid_to_facts(s, d):
    """E14 S18 F21 F22 M12 X26 X27"""
    cells = s.createDataFrame(GRID, "doc_id string, table_no int, r int, c int, text string")
    return tables.grid_facts(cells).select("canon", "comparator", "value_low", "value_high", "phase")


@query("SELECT * FROM (VALUES ('s',0::BIGINT,'Cu'),('s',1::BIGINT,'Ni')) t(sid,value_no,canon)", plain=True, fixture=True)
def enumeration_pairs(s, d):
    """J22"""
    rows = [("s", [(10, 12), (20, 22)], [(7, 9, "Cu"), (17, 19, "Ni"), (90, 92, "Fe")]), ("one", [(1, 2)], [(4, 6, "Cu")])]
    return spans.enumerated(s.createDataFrame(rows, "sid string, values array<struct<s:int,e:int>>, materials array<struct<s:int,e:int,canon:string>>"))


@query("SELECT * FROM (VALUES ('d',0),('d',3)) t(doc_id,pos)", plain=True, fixture=True)
def either_key_dedup(s, d):
    """What was dropped does not count"""
    rows = [("d", 0, "a", "m", 1.0, 1.0, "u", "q1"), ("d", 1, "a", "m", 1.0, 1.0, "u", "q2"), ("d", 2, "b", "m", 2.0, 2.0, "u", "Q1 "), ("d", 3, "c", "m", 3.0, 3.0, "u", "q2")]
    df = s.createDataFrame(rows, "doc_id string, pos int, canon string, metric string, value_low double, value_high double, unit_canon string, quote string")
    return relations.without_repeats(df).select("doc_id", "pos")


@query("SELECT * FROM (VALUES (0::BIGINT,'preamble'),(1::BIGINT,'science'),(2::BIGINT,'econ'),(3::BIGINT,'rubric')) t(segment,kind)", plain=True, fixture=True)
def journal_segments(s, d):
    """E13 F32 B04"""
    body = "слово " * 100
    issue = f"обложка\nУДК 669.2\n{body}\nУДК 338.5\n{body}\nУДК 622\nНОВОСТИ\n{body}"
    return text.article_segments(s.createDataFrame([("j", issue)], "doc_id string, text string")).select("segment", "kind")


@query("SELECT * FROM (VALUES ('patent'),('standard'),('other')) t(kind)", plain=True, fixture=True)
def document_types(s, d):
    """X17"""
    rows = s.createDataFrame([("Патент на изобретение", "a"), ("ГОСТ 123", "b"), ("просто текст", "c")], "text string, name string")
    return rows.select(text.doc_type(F.col("text"), F.col("name")).alias("kind"))


@query("SELECT * FROM (VALUES ('a\n\nb','x°C')) t(killed,unit)", plain=True, fixture=True)
def line_kill(s, d):
    """F20 X02"""
    rows = s.createDataFrame([("a\nhttps://x.y ISSN 1\nb", "x℃")], "t string, u string")
    return rows.select(text.kill_lines(F.col("t")).alias("killed"), text.degrees(F.col("u")).alias("unit"))


@query("SELECT * FROM (VALUES ('что медь растворяется','Иванов А.Б.+Петрова В.',true,false)) t(claim,authors,bad,ok)", plain=True, fixture=True)
def quotes_and_authors(s, d):
    """X10 X14 X15 X16 A24 T13"""
    rows = s.createDataFrame([("Показано, что что медь растворяется. Далее", "Петрова В., Иванов А.Б. статья", "a b c a b c a b c", "a b c d")], "c string, a string, b string, o string")
    return rows.select(text.claims(F.col("c")).alias("claim"), F.array_join(text.authors(F.col("a")), "+").alias("authors"), text.degenerate(F.col("b")).alias("bad"), text.degenerate(F.col("o")).alias("ok"))


def _marks(kind: str) -> str:
    """A class's list as a pattern without look-around, for DuckDB."""

    def one(word: str) -> str:
        body = "".join({"*": r"[\p{L}\p{N}_]*", "#": r"\d", " ": r"\s*"}.get(c) or (c if c.isalnum() or ord(c) > 127 else f"\\{c}") for c in word)
        first = r"(?:^|[^\p{L}\p{N}_])" if word[0].isalnum() else ""
        last = r"(?:$|[^\p{L}\p{N}_])" if word[-1].isalnum() else ""
        return first + body + last

    return f"(?i)(?:{'|'.join(map(one, text.DOC_TYPES[kind]))})"


@query(
    "SELECT origin, id, CASE " + " ".join(f"WHEN regexp_matches(t, '{_marks(k)}') THEN '{k}'" for k in text.DOC_TYPES) + """ ELSE 'other' END AS kind FROM
  (SELECT 'document' AS origin, doc_id AS id, coalesce(source,'') || chr(10) || coalesce(text,'') AS t FROM documents UNION ALL SELECT 'page', page_id, coalesce(url,'') || chr(10) || coalesce(html,'') FROM pages)""",
    plain=True,
)
def document_types_all(s, d):
    """Of whole texts and pages"""
    docs = _docs(s, d).select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), text.doc_type(F.col("text"), F.col("source")).alias("kind"))
    pages = ad.table(s, d, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), text.doc_type(F.col("html"), F.col("url")).alias("kind"))
    return docs.unionByName(pages)


_WORD_MARKS = r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(text.LINE_MARKS) + r")(?:$|[^\p{L}\p{N}_])"
_APPARATUS = " OR ".join(
    [f"regexp_matches(x, '{_WORD_MARKS}')", "regexp_matches(lower(x), '@[a-z0-9.-]+\\.[a-z]{2,}')"]
    + [f"contains(lower(x), '{p}')" for p in text.LINE_PARTS]
    + ["regexp_matches(x, '[»\"][\\s.]*20[0-9]{2}\\.\\s*№\\s*[0-9]')", r"""regexp_matches(x, '(?:^|[^\p{L}\p{N}_])(?:С\.\s*[0-9]+\s*[-–—]\s*[0-9]|Т\.\s*[0-9]+\.\s*№|Vol\.\s*[0-9]|No\.\s*[0-9]+,?\s*[Pp]\.)')"""]
)


@query(f"SELECT doc_id, md5(array_to_string(list_transform(string_split(coalesce(text,''), chr(10)), lambda x: CASE WHEN {_APPARATUS} THEN '' ELSE x END), chr(10))) AS kept, CAST(len(list_filter(string_split(coalesce(text,''), chr(10)), lambda x: {_APPARATUS})) AS BIGINT) AS killed FROM documents", plain=True)
def line_kill_all(s, d):
    """lines of apparatus in whole texts"""
    body = F.coalesce("text", F.lit(""))
    dead = F.size(F.filter(F.split(body, "\n", -1), text.apparatus)).cast("long")
    return _docs(s, d).select("doc_id", F.md5(text.kill_lines(body).cast("binary")).alias("kept"), dead.alias("killed"))


@query(r"""SELECT doc_id, CAST(arg_max(CAST(y AS INTEGER), (n, y)) AS INTEGER) AS year FROM (SELECT doc_id, y, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(' ' || substr(text,1,3000) || ' ', '[^0-9]', '  ', 'g'), ' ((?:19|20)[0-9][0-9]) ', 1)) AS y
  FROM (SELECT o_custkey AS doc_id, string_agg(strftime(o_orderdate, '%d.%m.%Y'), ' ' ORDER BY o_orderdate) AS text FROM orders GROUP BY 1)) GROUP BY 1,2) GROUP BY 1""", plain=True)
def year_mode_all(s, d):
    """Per customer, the year that the dates of all orders name most; texts hold no years here"""
    date = F.struct("o_orderdate", F.date_format("o_orderdate", "dd.MM.yyyy").alias("shown"))
    rows = ad.table(s, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(date)), lambda x: x["shown"]), " ").alias("text"))
    return text.year_modes(rows)


@query()
def noise_reasons(s, d):
    """Of all sentences, why each is left out"""
    rows = text.sentence_rows(_docs(s, d))
    return rows.select("doc_id", "sent_no", text.noise(F.col("sent")).alias("reason"))


@query()
def either_key_dedup_all(s, d):
    """Of all facts, in order of their keys"""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pkey", "author"))
    rows = ad.parameter(s, d).withColumn("pos", nth).select("doc_id", "pos", "canon", "metric", "value_low", "value_high", "unit_canon", "quote")
    return relations.without_repeats(rows).select("doc_id", "pos")


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(source), '" + "|".join(display.HOME_PLACES) + "') THEN 'RU' WHEN regexp_matches(lower(source), '" + "|".join(display.FOREIGN_PLACES) + "') THEN 'WORLD' WHEN upper(lang)='RU' THEN 'RU' WHEN upper(lang)='EN' THEN 'WORLD' END AS place FROM documents", plain=True)
def document_places(s, d):
    """X22 X23"""
    none = F.lit(None).cast("string")
    return _docs(s, d).select("doc_id", display.place(F.col("lang"), none, none, F.col("source"), none).alias("place"))


@query("""SELECT pkey, '- ' || concat_ws(' ', metric, CASE WHEN value_low=value_high THEN CAST(CAST(value_low AS BIGINT) AS VARCHAR) ELSE CAST(CAST(value_low AS BIGINT) AS VARCHAR) || '–' || CAST(CAST(value_high AS BIGINT) AS VARCHAR) END, unit_canon)
  || CASE WHEN phase IS NOT NULL THEN ' [' || phase || ']' ELSE '' END || CASE WHEN trim(quote)<>'' THEN ' — «' || trim(quote) || '»' ELSE '' END || ' — [«' || coalesce(nullif(name,''), CAST(doc_id AS VARCHAR)) || '» (' || coalesce(CAST(year AS VARCHAR),'б.г.') || ')](/sources?doc=' || CAST(doc_id AS VARCHAR) || ')' AS line
  FROM parameter JOIN document USING (doc_id)""")
def fact_lines(s, d):
    """X12 X13 X19"""
    c = F.col
    rows = ad.parameter(s, d).join(ad.document(s, d), "doc_id")
    return rows.select("pkey", display.bullet(c("metric"), c("value_low"), c("value_high"), c("unit_canon"), c("phase"), c("quote"), c("doc_id"), c("name"), c("year")).alias("line"))


ANSWERS = [
    ("d1", '{"tables":[{"phase":"Медный штейн","rows":[{"element":"Cu","value":"45,5","unit":"%"},{"element":"никель","value":"20-25","unit":"г/т"},{"element":"O","value":"5","unit":"%"},{"element":"Fe","value":"<3","unit":null},{"element":"S","value":"240","unit":"%"},{"element":"Zn","value":"много"}]}]}'),
    ("d2", "no json"),
    ("d3", None),
    ("d4", '{"tables":[]}'),
    ("d5", '{"tables":[{"rows":[{"element":"SiO2","value":"1999-2001","unit":"ppm"},{"element":"SiO2","value":"12","unit":"ppm"}]}]}'),
]


@query("SELECT * FROM (VALUES ('d1','Cu','pct','=',45.5::DOUBLE,45.5::DOUBLE,'штейн'),('d1','никель','g_t','=',20.0,25.0,'штейн'),('d1','Fe','pct','<',NULL,3.0,'штейн'),('d5','SiO2','pct','=',12.0,12.0,NULL)) t(doc_id,canon,unit_canon,comparator,value_low,value_high,phase)", plain=True, fixture=True)
def model_tables(s, d):
    """A model's answers, checked"""
    return tables.answered_facts(s.createDataFrame(ANSWERS, "doc_id string, answer string")).select("doc_id", "canon", "unit_canon", "comparator", "value_low", "value_high", "phase")
