"""Named queries of the address engine, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from addrforge.functions import geo, house_numbers, phonetic, similarity, text
from addrforge.operators import compat, query_city, retrieve, reverse, streets, validate
from addrforge.plans.fixtures import AREAS, areas, load, with_views
from addrforge.sources import address_csv

REQUESTS = """SELECT street_id AS query_id, name AS street_name,
  concat('', 1 + (street_id*7) % 60, CASE WHEN street_id % 5 = 0 THEN 'c' ELSE '' END) AS house_number, city, latitude AS lat, longitude AS lon
FROM v_streets"""

# ---- SQL fragments of the oracles -------------------------------------------------------------------------------


def q_norm(x: str) -> str:
    spelled = f"replace(replace(replace(replace(lower({x}),'ä','ae'),'ö','oe'),'ü','ue'),'ß','ss')"
    return rf"trim(regexp_replace(regexp_replace({spelled},'[^\p{{L}}\p{{N}}_\s\-]','','g'),'[\s\-]+',' ','g'))"


def q_compact(x: str) -> str:
    return f"replace({q_norm(x)},' ','')"


def q_collapse(x: str) -> str:
    """Runs to one letter: a list of letters filtered against its neighbour."""
    return f"array_to_string([c[1] for c in list_zip(string_split({x},''), list_concat([''], string_split({x},''))) if c[1] IS NOT NULL AND c[1] <> c[2]],'')"


def q_german_sounds(x: str) -> str:
    out = rf"regexp_replace(trim(lower({x})),'[^a-zäöüß\s\-]','','g')"
    rules = "ä>ae ö>oe ü>ue ß>ss bb>b cc>c dd>d ff>f gg>g hh>h kk>k ll>l mm>m nn>n pp>p rr>r ss>s tt>t zz>z ph>f th>t ch>x sch>x ck>k qu>kw chs>ks dt>t ts>z tz>z pf>f ah>a eh>e ih>i oh>o uh>u ei>ai ey>ai ay>ai eu>oi äu>oi ie>i v>f c>k"
    for rule in rules.split():
        a, b = rule.split(">")
        out = f"replace({out},'{a}','{b}')"
    return out


def q_german(x: str) -> str:
    s = q_german_sounds(x)
    return q_collapse(f"(left({s},1) || regexp_replace(substr({s},2),'[aeiou]','','g'))")


def q_cologne(x: str) -> str:
    """Contexts are rewritten first, letter pairs by capital stand-ins, then letters become digits and runs collapse."""
    s = f"regexp_replace(replace(replace(replace(replace(trim(lower({x})),'ä','ae'),'ö','oe'),'ü','ue'),'ß','ss'),'[^a-z]','','g')"
    letters = f"[CASE WHEN c IN ('a','e','i','j','o','u') THEN '0' WHEN c='b' THEN '1' WHEN c='p' THEN CASE WHEN n='h' THEN '3' ELSE '1' END WHEN c IN ('d','t') THEN CASE WHEN n IN ('c','s','z') THEN '8' ELSE '2' END WHEN c IN ('f','v','w') THEN '3' WHEN c IN ('g','k','q') THEN '4' WHEN c='c' AND i=1 THEN CASE WHEN n IN ('a','h','k','l','o','q','r','u','x') THEN '4' ELSE '8' END WHEN c='c' THEN CASE WHEN p IN ('s','z') THEN '8' WHEN n IN ('a','h','k','o','q','u','x') THEN '4' ELSE '8' END WHEN c='x' THEN CASE WHEN p IN ('c','k','q') THEN '8' ELSE '48' END WHEN c='l' THEN '5' WHEN c IN ('m','n') THEN '6' WHEN c='r' THEN '7' WHEN c IN ('s','z') THEN '8' ELSE '' END"
    return s, letters


def q_voice_root(x: str) -> str:
    return rf"trim(regexp_replace(trim(regexp_replace({x},'^(in\s+der|in\s+den|in\s+dem|an\s+der|an\s+den|an\s+dem|am|auf\s+der|auf\s+dem|auf\s+den|beim|im|zum|zur|hinter\s+der|hinter\s+dem|unter\s+der|unter\s+dem|vor\s+der|vor\s+dem|neben\s+der|neben\s+dem)\s+','','i')),'\s*(straße|strasse|weg|platz|gasse|allee|ring|damm|hof|park|berg|steig|pfad|ufer|graben|zeile|chaussee|promenade|brücke|brucke|kirche|markt|tor|bad|feld|grund|hang|tal|wall|anger|plan|stieg|winkel|siedlung)\s*$','','i'))"


GEO = "2*6371.0*asin(least(1.0,sqrt(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))))"


def q_km(a: str, b: str, c: str, d: str) -> str:
    return GEO.format(a=a, b=b, c=c, d=d)


def q_bonus(a: str, b: str) -> str:
    return "0.02e0*(" + "+".join(f"(CASE WHEN length({a})>={n} AND length({b})>={n} AND left({a},{n})=left({b},{n}) THEN 1 ELSE 0 END)" for n in range(1, 7)) + ")"


# ---- queries -----------------------------------------------------------------------------------------------------

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _streets(spark, d):
    return streets.derive(load(spark, d, "v_streets"))


def _names(spark, d):
    """Street names, queries and cities: what scalar functions are tried on."""
    s, q = load(spark, d, "v_streets"), load(spark, d, "v_queries")
    return s.select(F.col("street_id").alias("id"), F.lit("n").alias("kind"), F.col("name").alias("s")).unionByName(
        s.select(F.col("street_id").alias("id"), F.lit("c").alias("kind"), F.concat(F.lit("Stadt "), "city").alias("s"))
    ).unionByName(q.select(F.col("query_id").alias("id"), F.lit("q").alias("kind"), F.col("query").alias("s")))


NAMES = with_views("v_streets", "v_queries") + ", names AS (SELECT street_id AS id, 'n' AS kind, name AS s FROM v_streets UNION ALL SELECT street_id, 'c', concat('Stadt ', city) FROM v_streets UNION ALL SELECT query_id, 'q', query FROM v_queries)"


def scalar(name: str, column, sql: str):
    query(name, f"{NAMES} SELECT id, kind, {sql} AS value FROM names")(lambda spark, d: _names(spark, d).select("id", "kind", column(F.col("s")).alias("value")))


scalar("normalize_string", text.normalize_string, q_norm("s"))
scalar("normalize_compact", text.normalize_compact, q_compact("s"))
scalar("consonant_key", text.consonant_key, "array_to_string([" + q_collapse("(left(t,1) || regexp_replace(substr(t,2),'[aeiouyh]','','g'))") + f" for t in string_split({q_norm('s')},' ')],'')")
scalar("city_key", text.city_key, q_compact("regexp_replace(s,'^(kreis|stadt|gemeinde|hansestadt|landkreis) ','','i')"))
scalar("city_variants", lambda c: F.array_join(text.city_variants(c), "|"),
       "array_to_string(list_filter([s, replace(s,' ','-'), replace(s,'-',' '), regexp_replace(s,'^(kreis|stadt|gemeinde|hansestadt|landkreis) ','','i'), replace(regexp_replace(s,'^(kreis|stadt|gemeinde|hansestadt|landkreis) ','','i'),' ','-'), replace(regexp_replace(s,'^(kreis|stadt|gemeinde|hansestadt|landkreis) ','','i'),'-',' ')],"
       " lambda v, i: list_position([lower(z) for z in [s, replace(s,' ','-'), replace(s,'-',' '), regexp_replace(s,'^(kreis|stadt|gemeinde|hansestadt|landkreis) ','','i'), replace(regexp_replace(s,'^(kreis|stadt|gemeinde|hansestadt|landkreis) ','','i'),' ','-'), replace(regexp_replace(s,'^(kreis|stadt|gemeinde|hansestadt|landkreis) ','','i'),'-',' ')]], lower(v)) = i),'|')")  # fmt: skip
scalar("title_case", text.title_case, "CASE WHEN contains(s,'-') THEN array_to_string([upper(left(p,1)) || lower(substr(p,2)) for p in string_split(s,'-')],'-') ELSE array_to_string([upper(left(p,1)) || lower(substr(p,2)) for p in string_split(s,' ') if p <> ''],' ') END")
scalar("trigrams", lambda c: F.array_join(text.trigrams(text.normalize_compact(c)), " "), f"array_to_string([substr({q_compact('s')},i,3) for i in range(1,length({q_compact('s')})-1)],' ')")
scalar("hyphen_variants", lambda c: F.array_join(text.hyphen_variants(c), "|"), "CASE WHEN length(s)<3 THEN s WHEN contains(s,' ') AND contains(s,'-') THEN concat_ws('|', s, replace(s,' ','-'), replace(s,'-',' ')) WHEN contains(s,' ') THEN concat_ws('|', s, replace(s,' ','-')) WHEN contains(s,'-') THEN concat_ws('|', s, replace(s,'-',' ')) ELSE s END")
scalar("voice_root", lambda c: text.strip_voice_suffix(text.strip_voice_prefix(c)), q_voice_root("s"))
scalar("german_phonetic", phonetic.german_phrase, "array_to_string([" + q_german("t") + r" for t in regexp_split_to_array(lower(s),'[\s\-]+') if t <> ''],'')")
_S, _L = q_cologne("t")
query("cologne_phonetic", f"""{NAMES}, words AS (SELECT id, kind, k, {_S.replace('lower(t)', 'lower(t)')} AS w FROM (SELECT id, kind, unnest(range(1, len(ts)+1)) AS k, unnest(ts) AS t FROM (SELECT id, kind, regexp_split_to_array(lower(s),'[\\s\\-]+') AS ts FROM names))),
letters AS (SELECT id, kind, k, i, substr(w,i,1) AS c, CASE WHEN i>1 THEN substr(w,i-1,1) ELSE '' END AS p, substr(w,i+1,1) AS n FROM (SELECT id, kind, k, w, unnest(range(1,length(w)+1)) AS i FROM words)),
codes AS (SELECT id, kind, k, i, {_L[1:]} AS code FROM letters),
kept AS (SELECT *, lag(code) OVER (PARTITION BY id, kind, k ORDER BY i) AS before FROM codes WHERE code <> '')
SELECT n.id, n.kind, coalesce(string_agg(code, '' ORDER BY k, i) FILTER (before IS NULL OR before <> code), '') AS value FROM names n LEFT JOIN kept USING (id, kind) GROUP BY n.id, n.kind""")(
    lambda spark, d: _names(spark, d).select("id", "kind", phonetic.cologne_phrase(F.col("s")).alias("value"))
)


@query("german_phonetic_words", rf"""WITH words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text),'[ \n\-]+')) AS word FROM documents) SELECT word, {q_german('word')} AS code FROM words WHERE word <> ''""")
def german_phonetic_words(spark, d):
    words = load(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"[ \n\-]+")).alias("word")).filter("word <> ''").distinct()
    return words.select("word", phonetic.german_code(F.col("word")).alias("code"))


def q_once(x: str) -> str:
    """A list's first occurrences."""
    return f"[v[1] for v in list_zip({x}, range(1, len({x})+1)) if list_position({x}, v[1]) = v[2]]"


_N = q_norm("s")
_VARIANTS = f"list_concat([{_N}], [left({_N},i-1) || substr({_N},i+1,1) || substr({_N},i,1) || substr({_N},i+2) for i in range(1, length({_N}))], [left({_N},i-1) || substr({_N},i+1) for i in range(1, length({_N})+1)])"


@query("fuzzy_variants", f"{NAMES}, listed AS (SELECT id, kind, CASE WHEN length({_N}) < 3 THEN [{_N}] ELSE {_VARIANTS} END AS vs FROM names) SELECT id, kind, array_to_string({q_once('vs')}, '|') AS value FROM listed")
def fuzzy_variants(spark, d):
    return _names(spark, d).select("id", "kind", F.array_join(text.fuzzy_variants(F.col("s")), "|").alias("value"))


_COMMON = ", ".join(f"'{t}'" for t in text.COMMON_TRIGRAMS)


def q_selected(source: str, compact: str) -> str:
    """CTEs: every row of source with ts, the trigrams of its compact form that are searched."""
    return f"""g0 AS (SELECT *, [substr({compact},i,3) for i in range(1, length({compact})-1)] AS a FROM {source}), g1 AS (SELECT *, [t for t in a if t NOT IN ({_COMMON})] AS r FROM g0),
g2 AS (SELECT *, CASE WHEN len(a) >= 3 AND len(r) < 3 THEN a[1:len(a)//2+2] WHEN len(r) = 0 THEN a ELSE r END AS m FROM g1),
g3 AS (SELECT *, CASE WHEN len(m) >= 9 THEN list_concat(m[1:3], m[len(m)//2:len(m)//2+2]) WHEN len(m) >= 6 THEN list_concat(m[1:3], m[len(m)//2+1:len(m)//2+2], m[len(m)-1:]) WHEN len(m) >= 4 THEN m[1:3] ELSE m END AS w FROM g2),
selected AS (SELECT * EXCLUDE (a, r, m, w), {q_once('w')} AS ts FROM g3)"""


@query("selected_trigrams", f"{NAMES}, {q_selected('names', q_compact('s'))} SELECT id, kind, array_to_string(ts, ' ') AS value FROM selected")
def selected_trigrams(spark, d):
    return _names(spark, d).select("id", "kind", F.array_join(text.select_trigrams(text.trigrams(text.normalize_compact(F.col("s")))), " ").alias("value"))


@query("search_split", with_views("v_addresses") + r""", lines AS (SELECT address_id, concat(name, ' ', house_number, ', ', postal_code, ' ', city) AS line FROM v_addresses JOIN v_streets USING (street_id))
SELECT address_id, regexp_extract(trim(split_part(line, ',', 1)), '^(.+?)\s+(\d[\p{L}\p{N}_/\-]*)$', 1) AS street, regexp_extract(trim(split_part(line, ',', 1)), '^(.+?)\s+(\d[\p{L}\p{N}_/\-]*)$', 2) AS house_number, regexp_replace(trim(split_part(line, ',', 2)), '^\d{5}\s+', '') AS city FROM lines""")
def search_split(spark, d):
    a = load(spark, d, "v_addresses").select("address_id", "street_id", "house_number").join(load(spark, d, "v_streets").select("street_id", "name", "city", "postal_code"), "street_id")
    line = F.concat("name", F.lit(" "), "house_number", F.lit(", "), "postal_code", F.lit(" "), "city")
    return a.select("address_id", *(c.alias(k) for k, c in text.split_search(line).items()))


@query("house_number_parts", with_views("v_addresses") + r" SELECT address_id, CAST(regexp_extract(house_number, '^\s*(\d+)', 1) AS BIGINT) AS number, regexp_replace(house_number, '^\d+', '') AS suffix FROM v_addresses")
def house_number_parts(spark, d):
    return load(spark, d, "v_addresses").select("address_id", house_numbers.leading_number(F.col("house_number")).alias("number"), house_numbers.suffix(F.col("house_number")).alias("suffix"))


@query("haversine", with_views("v_addresses") + f" SELECT a.address_id, round({q_km('a.latitude', 'a.longitude', 's.latitude', 's.longitude')}, 6) AS km FROM v_addresses a JOIN v_streets s USING (street_id)")
def haversine(spark, d):
    a = load(spark, d, "v_addresses").select("address_id", "street_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    km = geo.haversine(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    return a.join(load(spark, d, "v_streets"), "street_id").select("address_id", F.round(km, 6).alias("km"))


@query("web_mercator", with_views("v_streets") + " SELECT street_id, round(degrees(2*atan(exp(latitude*100000/20037508.34*pi()))-pi()/2), 6) AS lat, round(longitude*100000/20037508.34*180, 6) AS lon FROM v_streets")
def web_mercator(spark, d):
    at = geo.from_web_mercator(F.col("longitude") * 100000, F.col("latitude") * 100000)
    return load(spark, d, "v_streets").select("street_id", F.round(at["lat"], 6).alias("lat"), F.round(at["lon"], 6).alias("lon"))


_WORDS = f"""q AS (SELECT query_id, {q_norm('query')} AS q FROM v_queries), b AS (SELECT query_id, q, {q_norm('name')} AS n FROM q JOIN v_streets ON street_id = query_id),
w AS (SELECT *, [list_min([CASE WHEN starts_with(y, x) THEN 0 ELSE least(3, levenshtein(x, y)) END for y in string_split(n, ' ')]) for x in string_split(q, ' ')] AS d FROM b)"""


@query("fuzzy_score", with_views("v_streets", "v_queries") + f""", {_WORDS} SELECT query_id, round(CASE WHEN q = n THEN 1e0 WHEN starts_with(n, q) THEN 0.95e0 WHEN contains(q, ' ') AND contains(n, ' ') AND list_max(d) <= 2 THEN greatest(0e0, 1 - list_avg(d)/2)*0.9e0
 WHEN levenshtein(q, n) <= 2 THEN (1 - levenshtein(q, n)::DOUBLE/greatest(length(q), length(n), 1))*0.8e0 ELSE 0e0 END, 6) AS score FROM w""")
def fuzzy_score(spark, d):
    q = retrieve.prepared(load(spark, d, "v_queries")).join(_streets(spark, d).select(F.col("street_id").alias("query_id"), "normalized_search"), "query_id")
    return q.select("query_id", F.round(similarity.fuzzy_score(F.col("qn"), F.col("normalized_search")), 6).alias("score"))


_Q = with_views("v_streets", "v_queries") + f", q AS (SELECT *, {q_norm('query')} AS qn, {q_compact('query')} AS qc FROM v_queries), s AS (SELECT *, {q_norm('name')} AS nn, {q_compact('name')} AS nc FROM v_streets)"


@query("levenshtein_join", f"{_Q} SELECT query_id, street_id, levenshtein(qc, nc)::INTEGER AS edits FROM q JOIN s ON left(qc,1) = left(nc,1) AND abs(length(qc)-length(nc)) <= 3 AND levenshtein(qc, nc) <= 3")
def levenshtein_join(spark, d):
    return retrieve.levenshtein_join(load(spark, d, "v_queries"), _streets(spark, d))


@query("prefix_search", f"""{_Q}, hit AS (SELECT query_id, street_id, (CASE WHEN starts_with(name, CASE WHEN contains(query,'-') THEN array_to_string([upper(left(p,1)) || lower(substr(p,2)) for p in string_split(query,'-')],'-') ELSE array_to_string([upper(left(p,1)) || lower(substr(p,2)) for p in string_split(query,' ') if p <> ''],' ') END) THEN 1.0e0 ELSE 0.97e0 END)
 + (CASE WHEN regexp_matches(lower(name),'straße|strasse') THEN 0.02e0 ELSE 0.0e0 END) AS score
FROM q JOIN s ON starts_with(nc, qc) AND latitude BETWEEN lat - 35/110.574 AND lat + 35/110.574 AND longitude BETWEEN lon - 35/(111.320*greatest(1e-4,cos(radians(lat)))) AND lon + 35/(111.320*greatest(1e-4,cos(radians(lat)))))
SELECT query_id, street_id, 'A' AS stage, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, street_id) AS r FROM hit) WHERE r <= 50""")
def prefix_search(spark, d):
    return retrieve.prefix_search(load(spark, d, "v_queries"), _streets(spark, d)).withColumn("score", F.round("score", 6))


@query("typo_search", f"""{_Q}, hit AS (SELECT query_id, street_id, round(0.62e0 + {q_bonus('qc', 'nc')}, 6) AS score FROM q JOIN s ON length(qn) >= 3 AND ({' OR '.join(f"(length(qn) >= {i} AND nn LIKE concat('%', left(qn,{i - 1}), '_', substr(qn,{i + 1}), '%'))" for i in range(1, 5))}))
SELECT query_id, street_id, 'C' AS stage, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, street_id) AS r FROM hit) WHERE r <= 80""")
def typo_search(spark, d):
    return retrieve.typo_search(load(spark, d, "v_queries"), _streets(spark, d))


@query("trigram_postings", with_views("v_streets") + f", g AS (SELECT street_id, unnest([substr(nc,i,3) for i in range(1,length(nc)-1)]) AS trigram FROM (SELECT street_id, {q_compact('name')} AS nc FROM v_streets)) SELECT trigram, street_id, count(*) AS tf, sum(count(*)) OVER (PARTITION BY street_id)::INTEGER AS n_trigrams FROM g GROUP BY trigram, street_id")
def trigram_postings(spark, d):
    return retrieve.postings(_streets(spark, d)).select("trigram", "street_id", "tf", "n_trigrams")


_BM25 = f"""{_Q}, {q_selected('q', 'qc')}, g AS (SELECT street_id, trigram, count(*) AS tf, any_value(n) AS n FROM (SELECT street_id, length(nc)-2 AS n, unnest([substr(nc,i,3) for i in range(1,length(nc)-1)]) AS trigram FROM s) GROUP BY ALL),
z AS (SELECT count(*) AS n_docs, avg(n) AS mean_n FROM (SELECT street_id, any_value(n) AS n FROM g GROUP BY ALL)), f AS (SELECT trigram, count(*) AS df FROM g GROUP BY ALL), a AS (SELECT query_id, unnest(ts) AS trigram FROM selected),
h AS (SELECT query_id, street_id, round(sum(greatest(1e-6, ln((n_docs-df+0.5e0)/(df+0.5e0)))*tf*2.2e0/(tf+1.2e0*(0.25e0+0.75e0*n/mean_n))), 6) AS bm25 FROM a JOIN g USING (trigram) JOIN f USING (trigram), z GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, street_id) AS r FROM h)"""


@query("trigram_bm25", f"{_BM25} SELECT query_id, street_id, 'B' AS stage, bm25, round(bm25/(6+bm25), 6) AS score FROM o WHERE r <= 20")
def trigram_bm25(spark, d):
    return retrieve.trigram_bm25(load(spark, d, "v_queries"), _streets(spark, d))


@query("fuzzy_trigram", f"""{_BM25}, e AS (SELECT query_id, street_id, round(CASE levenshtein(qc, nc) WHEN 0 THEN 1e0 WHEN 1 THEN 0.9e0 WHEN 2 THEN 0.75e0 ELSE 0.6e0 END + {q_bonus('qc', 'nc')}, 6) AS score FROM o JOIN q USING (query_id) JOIN s USING (street_id) WHERE r <= 150 AND levenshtein(qc, nc) <= 3)
SELECT query_id, street_id, 'G' AS stage, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, street_id) AS r FROM e) WHERE r <= 20""")
def fuzzy_trigram(spark, d):
    return retrieve.fuzzy_trigram(load(spark, d, "v_queries"), _streets(spark, d))


@query("phonetic_search")
def phonetic_search(spark, d):
    return retrieve.phonetic_search(load(spark, d, "v_queries"), _streets(spark, d))


@query("broad_search")
def broad_search(spark, d):
    return retrieve.broad_search(load(spark, d, "v_queries"), _streets(spark, d))


@query("autocomplete")
def autocomplete(spark, d):
    return retrieve.autocomplete(load(spark, d, "v_queries"), _streets(spark, d))


@query("geojson")
def geojson(spark, d):
    return compat.geojson_collections(autocomplete(spark, d))


@query("nominatim_rows")
def search_rows(spark, d):
    return compat.search_rows(autocomplete(spark, d))


def _requests(spark, d):
    return spark.sql(REQUESTS.replace("FROM v_streets", "FROM {v}"), v=load(spark, d, "v_streets"))


@query("validate_exact", with_views("v_addresses") + f""", q AS ({REQUESTS}), hit AS (SELECT q.query_id, a.address_id, s.street_id, round({q_km('q.lat', 'q.lon', 'a.latitude', 'a.longitude')}, 6) AS km,
 bool_or(TRUE) OVER () AS t FROM q JOIN v_streets s ON {q_norm('q.street_name')} = {q_norm('s.name')} AND s.city = q.city AND s.latitude BETWEEN q.lat - 50/110.574 AND q.lat + 50/110.574 AND s.longitude BETWEEN q.lon - 50/(111.320*cos(radians(q.lat))) AND q.lon + 50/(111.320*cos(radians(q.lat))) JOIN v_addresses a ON a.street_id = s.street_id AND a.house_number = q.house_number)
SELECT query_id, address_id, street_id, km AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY km, street_id) AS r FROM hit) WHERE r = 1""")
def validate_exact(spark, d):
    found = validate.validate(_requests(spark, d), _streets(spark, d), load(spark, d, "v_addresses"))
    return found.filter("match = 1").select("query_id", "address_id", "street_id", "distance_km")


def q_city_key(x: str) -> str:
    return q_compact(f"regexp_replace({x},'^(kreis|stadt|gemeinde|hansestadt|landkreis) ','','i')")


def _q_number(x: str) -> str:
    return rf"try_cast(regexp_extract({x}, '^\s*(\d+)', 1) AS BIGINT)"


def _q_rest(x: str) -> str:
    return rf"lower(trim(regexp_replace(trim({x}), '^\d+', '')))"


Q_KM = f"""round({q_km('lat', 'lon', 'coalesce(a.latitude, s_lat)', 'coalesce(a.longitude, s_lon)')}, 6)"""


def q_points(km: str = Q_KM) -> str:
    """The addresses of the candidates k; the caller goes on with FROM."""
    return f"""b AS (SELECT k.*, address_id, a.house_number AS found, {km} AS km, bool_or(address_id IS NOT NULL) OVER (PARTITION BY query_id) AS numbered,
 {_q_number('target')} AS t, {_q_number('a.house_number')} AS f, {_q_rest('target')} AS ts, {_q_rest('a.house_number')} AS fs"""


def q_best(order: str, more: str = "") -> str:
    """Of the points b the closest number of each street, then the streets in order."""
    return f"""m AS (SELECT *, CASE WHEN trim(found) = trim(target) THEN 1 WHEN NOT numbered THEN 2 WHEN address_id IS NOT NULL THEN 3 END AS match, CASE WHEN trim(found) = trim(target) THEN 0 WHEN t IS NULL THEN 1 WHEN f = t AND fs = ts THEN 2 WHEN f = t THEN 3 WHEN f IS NOT NULL THEN 4 ELSE 5 END AS rank FROM b),
g AS (SELECT *, CASE rank WHEN 3 THEN CASE WHEN fs = '' THEN 0 WHEN ts = '' THEN 1 WHEN length(ts) = 1 AND length(fs) = 1 THEN abs(ascii(ts) - ascii(fs)) ELSE abs(length(ts) - length(fs)) + 1 END WHEN 4 THEN abs(f - t) ELSE 0 END AS gap FROM m WHERE match IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, street_id ORDER BY match, rank, gap, CASE WHEN rank IN (3, 4) THEN 0 ELSE address_id END, found, km, address_id) AS r FROM g),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS first FROM p WHERE r = 1)
SELECT q.query_id, match IS NOT NULL AS exists, match, street_id, address_id, name AS street_name, z.city, postal_code, CASE WHEN match = 2 THEN '0' ELSE found END AS house_number, km AS distance_km{more} FROM q LEFT JOIN (SELECT * FROM z WHERE first = 1) z USING (query_id)"""


def q_validate(kept: str, order: str) -> str:
    """One answer a request: candidates that are kept, the nearest number of each street, then the streets in order."""
    return with_views("v_streets", "v_addresses") + f""", q AS ({REQUESTS}), sk AS (SELECT *, {q_norm('name')} AS nn, {q_city_key('city')} AS ck FROM v_streets), qk AS (SELECT *, {q_norm('street_name')} AS qn, {q_city_key('city')} AS qck FROM q),
c AS (SELECT query_id, qk.house_number AS target, lat, lon, street_id, name, sk.city, postal_code, latitude AS s_lat, longitude AS s_lon,
 latitude BETWEEN lat - 50/110.574 AND lat + 50/110.574 AND longitude BETWEEN lon - 50/(111.320*greatest(1e-4,cos(radians(lat)))) AND lon + 50/(111.320*greatest(1e-4,cos(radians(lat)))) AS near FROM qk JOIN sk ON nn = qn AND (starts_with(ck, qck) OR starts_with(qck, ck))),
k AS (SELECT *, bool_or(near) OVER (PARTITION BY query_id) AS any_near FROM c),
{q_points()} FROM k LEFT JOIN v_addresses a USING (street_id) WHERE {kept}),
{q_best(order)}"""


@query("validate", q_validate("near OR NOT any_near", "match, km, rank, gap, street_id"))
def validate_all(spark, d):
    return validate.validate(_requests(spark, d), _streets(spark, d), load(spark, d, "v_addresses"))


def q_near(km: int) -> str:
    along = f"{km}/(111.320*greatest(1e-4,cos(radians(lat))))"
    return f"latitude BETWEEN lat - {km}/110.574 AND lat + {km}/110.574 AND longitude BETWEEN lon - {along} AND lon + {along}"


def q_validate_voice(requests: str = REQUESTS) -> str:
    """Candidates by name; of requests without any by the opening of the name or of its sounds; of those without any the ten that sound best nearby."""
    spelled, code = q_cologne("t")
    in_city, near = "(qck IS NULL OR starts_with(ck, qck) OR starts_with(qck, ck))", f"(lat IS NULL OR ({q_near(50)}))"
    opens = lambda a, b: f"({a} <> '' AND starts_with({b}, left({a}, greatest(1, length({a}) - 1))))"
    alike = lambda a, b: f"(CASE WHEN {a} = {b} THEN 1e0 WHEN {a} = '' OR {b} = '' THEN 0e0 ELSE 1 - levenshtein({a}, {b})/greatest(length({a}), length({b})) END)"
    first = lambda x: f"upper(left({x}, 1))"
    return with_views("v_streets", "v_addresses") + rf""", q AS ({requests}), sk AS (SELECT *, {q_norm('name')} AS nn, {q_city_key('city')} AS ck FROM v_streets), qk AS (SELECT *, {q_norm('street_name')} AS qn, {q_city_key('city')} AS qck FROM q),
c1 AS (SELECT query_id, street_id, NULL::DOUBLE AS confidence, 'exact' AS match_type FROM (SELECT query_id, qn, qck, lat, lon FROM qk) JOIN sk ON nn = qn AND {in_city} AND {near}),
o2 AS (SELECT * FROM qk WHERE query_id NOT IN (SELECT query_id FROM c1)),
said AS (SELECT s, {q_voice_root('s')} AS root FROM (SELECT name AS s FROM sk UNION SELECT street_name FROM o2)),
words AS (SELECT kind, s, k, {spelled} AS w FROM (SELECT 'phrase' AS kind, s, unnest(range(1, len(ts)+1)) AS k, unnest(ts) AS t FROM (SELECT s, regexp_split_to_array(lower(s),'[\s\-]+') AS ts FROM said) UNION ALL SELECT 'root', s, 1, root FROM said)),
letters AS (SELECT kind, s, k, i, substr(w,i,1) AS c, CASE WHEN i>1 THEN substr(w,i-1,1) ELSE '' END AS p, substr(w,i+1,1) AS n FROM (SELECT kind, s, k, w, unnest(range(1,length(w)+1)) AS i FROM words)),
sounds AS (SELECT kind, s, k, i, {code[1:]} AS code FROM letters),
kept AS (SELECT *, lag(code) OVER (PARTITION BY kind, s, k ORDER BY i) AS before FROM sounds WHERE code <> ''),
cologne AS (SELECT s, coalesce(string_agg(code, '' ORDER BY k, i) FILTER (kind = 'phrase'), '') AS cp, coalesce(string_agg(code, '' ORDER BY k, i) FILTER (kind = 'root'), '') AS cr FROM kept WHERE before IS NULL OR before <> code GROUP BY s),
codes AS (SELECT s, root, {q_compact('s')} AS compact, array_to_string([{q_german('t')} for t in regexp_split_to_array(lower(s),'[\s\-]+') if t <> ''],'') AS gp, {q_german('root')} AS gr, coalesce(cp, '') AS cp, coalesce(cr, '') AS cr FROM said LEFT JOIN cologne USING (s)),
heard AS (SELECT * FROM codes WHERE s IN (SELECT street_name FROM o2)),
names AS (SELECT a.s AS street_name, b.s AS name, starts_with(b.compact, a.compact) OR {opens('a.gp', 'b.gp')} OR {opens('a.cp', 'b.cp')} AS opens,
 {first('b.s')} IN ({first('a.root')}, {first('a.s')}) AND a.root <> '' AS meets, round(0.4e0*{alike('a.gr', 'b.gr')} + 0.6e0*CASE WHEN a.cr = '' OR b.cr = '' THEN 0e0 ELSE {alike('a.cr', 'b.cr')} END, 6) AS score FROM heard a, codes b),
c2 AS (SELECT query_id, street_id, NULL::DOUBLE AS confidence, 'exact' AS match_type FROM (SELECT query_id, street_name, qck, lat, lon FROM o2) JOIN (SELECT street_name, name FROM names WHERE opens) USING (street_name) JOIN sk USING (name) WHERE {in_city} AND {near}),
o3 AS (SELECT * FROM o2 WHERE query_id NOT IN (SELECT query_id FROM c2) AND lat IS NOT NULL AND lon IS NOT NULL),
h AS (SELECT query_id, street_id, score, round({q_km('lat', 'lon', 'latitude', 'longitude')}, 6) AS km FROM (SELECT query_id, street_name, qck, lat, lon FROM o3) JOIN (SELECT street_name, name, score FROM names WHERE meets AND score >= 0.65) USING (street_name) JOIN sk USING (name) WHERE {in_city} AND {q_near(20)}),
c3 AS (SELECT query_id, street_id, max(score) OVER (PARTITION BY query_id) AS confidence, 'phonetic_voice' AS match_type FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, km, street_id) AS r FROM h) WHERE r <= 10),
c AS (FROM c1 UNION ALL FROM c2 UNION ALL FROM c3),
k AS (SELECT query_id, qk.house_number AS target, lat, lon, street_id, name, sk.city, postal_code, latitude AS s_lat, longitude AS s_lon, confidence, match_type FROM c JOIN qk USING (query_id) JOIN sk USING (street_id)),
{q_points(f'CASE WHEN lat IS NULL THEN 0e0 ELSE {Q_KM} END')} FROM k LEFT JOIN v_addresses a ON a.street_id = k.street_id AND trim(target) IS DISTINCT FROM '0'),
{q_best('match, rank, gap, km, street_id', ', match_type, confidence')}"""


@query("validate_voice", q_validate_voice())
def validate_voice(spark, d):
    return validate.validate(_requests(spark, d), _streets(spark, d), load(spark, d, "v_addresses"), voice=True)


@query("voice_candidates")
def voice_candidates(spark, d):
    return validate.voice_candidates(_requests(spark, d), _streets(spark, d))


_REV_A = with_views("v_addresses", "v_queries") + f""", hit AS (SELECT query_id, address_id, street_id, house_number, {q_km('lat', 'lon', 'latitude', 'longitude')} AS km FROM v_queries JOIN v_addresses ON latitude BETWEEN lat-0.01 AND lat+0.01 AND longitude BETWEEN lon-0.01 AND lon+0.01)
SELECT query_id, address_id, street_id, house_number, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(km,9), address_id) AS r FROM hit WHERE km <= {{km}}) WHERE r = 1"""


@query("reverse_address", _REV_A.format(km=0.2))
def reverse_address(spark, d):
    return reverse.nearest_addresses(load(spark, d, "v_queries"), load(spark, d, "v_addresses"), 0.2).select("query_id", "address_id", "street_id", "house_number", F.round("km", 6).alias("km"))


@query("reverse_segment", with_views("v_segments", "v_queries") + f""", p AS (SELECT query_id, segment_id, street_id, lat, lon, start_lat, start_lon, end_lat, end_lon, cos(radians((lat+start_lat+end_lat)/3)) AS k FROM v_queries JOIN v_segments ON max_lat >= lat-0.05 AND min_lat <= lat+0.05 AND max_lon >= lon-0.09 AND min_lon <= lon+0.09),
t AS (SELECT *, CASE WHEN pow((end_lon-start_lon)*k,2)+pow(end_lat-start_lat,2) < 1e-12 THEN 0 ELSE greatest(0,least(1,((lon-start_lon)*k*(end_lon-start_lon)*k+(lat-start_lat)*(end_lat-start_lat))/(pow((end_lon-start_lon)*k,2)+pow(end_lat-start_lat,2)))) END AS t FROM p),
hit AS (SELECT *, {q_km('lat', 'lon', '(start_lat+t*(end_lat-start_lat))', '(start_lon+t*(end_lon-start_lon))')} AS km FROM t)
SELECT query_id, segment_id, street_id, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(km,9), segment_id) AS r FROM hit WHERE km <= 5) WHERE r = 1""")
def reverse_segment(spark, d):
    return reverse.nearest_segments(load(spark, d, "v_queries"), load(spark, d, "v_segments")).select("query_id", "segment_id", "street_id", F.round("km", 6).alias("km"))


POINTS = "SELECT query_id, lat + CASE query_id % 4 WHEN 0 THEN 0.0e0 ELSE 0.1e0 END AS lat, lon FROM v_queries"


@query("reverse", with_views("v_segments", "v_addresses", "v_queries") + f""", points AS ({POINTS}),
near AS (SELECT query_id, address_id, street_id, house_number, latitude, longitude, {q_km('lat', 'lon', 'latitude', 'longitude')} AS km FROM points JOIN v_addresses ON latitude BETWEEN lat-0.01 AND lat+0.01 AND longitude BETWEEN lon-0.01 AND lon+0.01),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(km,9), address_id) AS r FROM near WHERE km <= 0.1) WHERE r = 1),
p AS (SELECT query_id, segment_id, street_id, lat, lon, start_lat, start_lon, end_lat, end_lon, cos(radians((lat+start_lat+end_lat)/3)) AS k FROM points JOIN v_segments ON max_lat >= lat-0.05 AND min_lat <= lat+0.05 AND max_lon >= lon-0.09 AND min_lon <= lon+0.09),
t AS (SELECT *, CASE WHEN pow((end_lon-start_lon)*k,2)+pow(end_lat-start_lat,2) < 1e-12 THEN 0 ELSE greatest(0,least(1,((lon-start_lon)*k*(end_lon-start_lon)*k+(lat-start_lat)*(end_lat-start_lat))/(pow((end_lon-start_lon)*k,2)+pow(end_lat-start_lat,2)))) END AS t FROM p),
met AS (SELECT *, start_lat+t*(end_lat-start_lat) AS at_lat, start_lon+t*(end_lon-start_lon) AS at_lon FROM t), hit AS (SELECT *, {q_km('lat', 'lon', 'at_lat', 'at_lon')} AS km FROM met),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(km,9), segment_id) AS r FROM hit WHERE km <= 5) WHERE r = 1)
SELECT q.query_id, coalesce(a.km, s.km) IS NOT NULL AS exists, a.address_id, CASE WHEN a.km IS NULL THEN s.segment_id END AS segment_id, coalesce(a.street_id, s.street_id) AS street_id, a.house_number,
 coalesce(a.latitude, round(s.at_lat, 6)) AS latitude, coalesce(a.longitude, round(s.at_lon, 6)) AS longitude, round(coalesce(a.km, s.km), 6) AS distance_km, CASE WHEN coalesce(a.km, s.km) <= 0.1 THEN 1 WHEN coalesce(a.km, s.km) <= 1 THEN 2 WHEN coalesce(a.km, s.km) <= 5 THEN 3 END AS level
FROM points q LEFT JOIN a USING (query_id) LEFT JOIN s USING (query_id)""")
def reverse_all(spark, d):
    points = spark.sql(POINTS.replace("FROM v_queries", "FROM {v}"), v=load(spark, d, "v_queries"))
    return reverse.reverse(points, load(spark, d, "v_addresses"), load(spark, d, "v_segments"))


_AREAS = "areas(layer, key, min_lat, max_lat, min_lon, max_lon) AS (VALUES " + ", ".join(f"('{a[0]}', '{a[1]}', {a[2]}, {a[3]}, {a[4]}, {a[5]})" for a in AREAS) + ")"


@query("point_in_area", with_views("v_streets") + f", {_AREAS}, hit AS (SELECT street_id AS id, layer, key, row_number() OVER (PARTITION BY street_id, layer ORDER BY (max_lat-min_lat)*(max_lon-min_lon), key) AS r FROM v_streets JOIN areas ON latitude BETWEEN min_lat AND max_lat AND longitude BETWEEN min_lon AND max_lon) SELECT id, layer, key FROM hit WHERE r = 1")
def point_in_area(spark, d):
    return reverse.areas_of_points(load(spark, d, "v_streets").select(F.col("street_id").alias("id"), "latitude", "longitude"), areas(spark))


@query("area_city", with_views("v_streets") + f", {_AREAS} SELECT street_id AS id, (SELECT key FROM areas WHERE latitude BETWEEN min_lat AND max_lat AND longitude BETWEEN min_lon AND max_lon ORDER BY list_position(['level8','level6','level4','level5','level7','borough','suburb'], layer) LIMIT 1) AS city FROM v_streets")
def area_city(spark, d):
    return reverse.city_of_points(load(spark, d, "v_streets").select(F.col("street_id").alias("id"), "latitude", "longitude"), areas(spark))


@query("known_cities", with_views("v_streets") + " SELECT DISTINCT lower(city) AS city FROM v_streets")
def known_cities(spark, d):
    return load(spark, d, "v_streets").select(F.lower("city").alias("city")).distinct()


@query("city_centroids", with_views("v_streets") + " SELECT city, round(avg(latitude),6) AS latitude, round(avg(longitude),6) AS longitude, count(*) AS n_streets FROM v_streets GROUP BY city")
def city_centroids(spark, d):
    return streets.city_centroids(load(spark, d, "v_streets")).withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


ASKED = """SELECT street_id AS query_id, concat(lower(name), ' ', CASE street_id % 4 WHEN 0 THEN lower(city) WHEN 1 THEN replace(lower(city),'ü','ue') WHEN 2 THEN substring(lower(city),1,2 + street_id % 3) ELSE 'xyz' END) AS query,
  latitude + (street_id % 3) * 1.0e0 AS lat, longitude AS lon FROM v_streets"""


@query("query_city", with_views("v_streets") + f""", q AS ({ASKED}), c AS (SELECT city, lower(city) AS low, {q_compact('city')} AS comp, avg(latitude) AS c_lat, avg(longitude) AS c_lon FROM v_streets GROUP BY city),
w AS (SELECT *, string_split(query, ' ') AS ws FROM q), e AS (SELECT *, lower(array_to_string(ws[len(ws)-n+1:], ' ')) AS tail, array_to_string(ws[:len(ws)-n], ' ') AS street FROM (SELECT *, unnest(range(1, least(3, len(ws)-1)+1)) AS n FROM w)),
m AS (SELECT *, CASE WHEN kind = 2 AND km <= 80 THEN 0 ELSE 1 END AS far FROM (SELECT *, CASE WHEN tail = low THEN 0 WHEN {q_compact('tail')} = comp THEN 1 WHEN n = 1 AND length(tail) >= 3 AND starts_with(comp, {q_compact('tail')}) THEN 2 END AS kind, {q_km('lat', 'lon', 'c_lat', 'c_lon')} AS km FROM e, c) WHERE kind IS NOT NULL),
b AS (SELECT query_id, street, CASE WHEN far = 0 THEN city ELSE low END AS city FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, kind, far, CASE WHEN far = 0 THEN km ELSE 0 END, length(low), low, city) AS r FROM m) WHERE r = 1)
SELECT q.query_id, coalesce(b.street, q.query) AS street_query, b.city AS detected_city FROM q LEFT JOIN b USING (query_id)""")
def city_of_queries(spark, d):
    found = load(spark, d, "v_streets")
    return query_city.split_city(spark.sql(ASKED.replace("FROM v_streets", "FROM {v}"), v=found), streets.city_centroids(found))


_HOLES = "(SELECT street_id, name, CASE WHEN street_id % 7 = 0 THEN '' ELSE city END AS city, concat('', 10000 + street_id % 400) AS postal_code FROM v_streets)"


def _holed(spark, d):
    return load(spark, d, "v_streets").select("street_id", "name", F.expr("CASE WHEN street_id % 7 = 0 THEN '' ELSE city END").alias("city"), F.expr("concat('', 10000 + street_id % 400)").alias("postal_code"))


@query("fill_empty_cities", with_views("v_streets") + f", h AS {_HOLES}, n AS (SELECT postal_code, city, count(*) AS n FROM h WHERE city <> '' GROUP BY ALL), m AS (SELECT postal_code, city FROM (SELECT *, row_number() OVER (PARTITION BY postal_code ORDER BY n DESC, city) AS r FROM n) WHERE r = 1) SELECT h.street_id, h.name, h.postal_code, m.city FROM h JOIN m USING (postal_code) WHERE h.city = '' AND NOT EXISTS (SELECT 1 FROM h o WHERE o.city <> '' AND o.name = h.name AND o.postal_code = h.postal_code AND o.city = m.city)")
def fill_empty_cities(spark, d):
    return streets.fill_empty_cities(_holed(spark, d)).select("street_id", "name", "postal_code", "city")


@query("delete_empty_twins", with_views("v_streets") + f", h AS {_HOLES} SELECT * FROM h WHERE city <> '' OR NOT EXISTS (SELECT 1 FROM h o WHERE o.city <> '' AND o.name = h.name AND o.postal_code = h.postal_code)")
def delete_empty_twins(spark, d):
    return streets.without_empty_twins(_holed(spark, d))


@query("upsert_last_wins", with_views("v_streets") + " SELECT name, city, street_id, latitude, longitude FROM (SELECT *, row_number() OVER (PARTITION BY name, city ORDER BY street_id DESC) AS r FROM v_streets) WHERE r = 1")
def upsert_last_wins(spark, d):
    return streets.upsert(load(spark, d, "v_streets").drop("postal_code"), ["name", "city"], ["street_id"])


@query("insert_ignore", with_views("v_addresses") + " SELECT house_number, address_id, street_id FROM (SELECT *, row_number() OVER (PARTITION BY house_number ORDER BY address_id) AS r FROM v_addresses) WHERE r = 1")
def insert_ignore(spark, d):
    return streets.insert_ignore(load(spark, d, "v_addresses").select("house_number", "address_id", "street_id"), ["house_number"], ["address_id"])


@query("segment_grouping", with_views("v_segments") + " SELECT street_id, round(avg((start_lat+end_lat)/2),9) AS latitude, round(avg((start_lon+end_lon)/2),9) AS longitude, count(*) AS n_segments, min(min_lat) AS min_lat, max(max_lat) AS max_lat FROM v_segments GROUP BY street_id")
def segment_grouping(spark, d):
    return streets.group_segments(load(spark, d, "v_segments"), ["street_id"]).withColumns({c: F.round(c, 9) for c in ("latitude", "longitude")})


@query("csv_resolve", with_views("v_addresses") + " SELECT lower(name) AS name, lower(city) AS city, postal_code, count(*) AS n_rows FROM v_addresses JOIN v_streets USING (street_id) GROUP BY ALL")
def csv_resolve(spark, d):
    a = load(spark, d, "v_addresses").join(load(spark, d, "v_streets").select("street_id", "name", "city", "postal_code"), "street_id")
    raw = a.select(F.col("name").alias("Strasse"), F.col("house_number").alias("Hausnummer"), F.concat("city", F.lit(", Kreis")).alias("Gemeindename"), F.col("postal_code").alias("PLZ"), F.concat(F.lit("POINT("), F.col("longitude") * 111319.49, F.lit(" "), F.col("latitude") * 111319.49, F.lit(")")).alias("WKT"))
    return address_csv.streets_of(address_csv.resolve(raw)).select(F.lower("name").alias("name"), F.lower("city").alias("city"), "postal_code", "n_rows")
