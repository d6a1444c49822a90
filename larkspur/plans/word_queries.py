"""Queries of words: what names, labels and questions say. Texts are made of a table's columns; the SQL works out of the same texts what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import intents as I
from ..operators import labels, matching, recommend
from ..operators import profiles as P
from .registry import query


def _made(t, **columns: str):
    """Parts with columns made by SQL expressions that both engines read; each is made once."""
    rows = t("part").select("p_partkey", *[F.expr(e).alias(n) for n, e in columns.items()])
    return rows.select("p_partkey", F.explode(F.array(F.struct(*columns))).alias("r")).select("p_partkey", "r.*")


# ---- labels

_LABEL = "p_name || ', ' || CASE p_partkey % 5 WHEN 0 THEN 'Semi-Dry' WHEN 1 THEN 'extra brut' WHEN 2 THEN 'moelleux' WHEN 3 THEN 'Secco' ELSE 'ab' END || ' (' || (1900 + p_size * 3) || ') «' || lower(p_type) || '»/' || p_partkey || '.'"


@query(rf"""WITH l AS (SELECT p_partkey, {_LABEL} AS text FROM part), s AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'semi-dry', ' polusuhoe '), 'moelleux', ' polusladkoe '), 'extra brut', ' ekstra bryut '), 'secco', ' suhoe ') AS text FROM l),
t AS (SELECT p_partkey, list_distinct(regexp_extract_all(text, '[a-z0-9]+')) AS tokens FROM s)
SELECT p_partkey, array_to_string(list_sort(list_filter(tokens, lambda x: length(x) >= 3 AND (NOT regexp_matches(x, '^[0-9]+$') OR regexp_matches(x, '^(19[5-9][0-9]|20[0-3][0-9])$')))), ' ') AS tokens FROM t""")
def label_tokens(t):
    """Tokens of labels made of parts: sweetness in other languages, years, other numbers, short words."""
    return _made(t, text=_LABEL).select("p_partkey", F.array_join(F.array_sort(labels.query_tokens(F.col("text"))), " ").alias("tokens"))


_SLUG = "CASE p_partkey % 6 WHEN 0 THEN 'vino-polusuhoe-' || p_partkey WHEN 1 THEN 'x-ekstra-bryut-' || p_size WHEN 2 THEN 'suhoe-' || p_size WHEN 3 THEN 'desertnoe' ELSE replace(p_name, ' ', '-') END"
_PHOTO = "CASE p_size % 5 WHEN 0 THEN 'сладкое ' || p_name || '.jpg' WHEN 1 THEN p_name || ' Брют.png' WHEN 2 THEN 'semi-dry-' || p_name WHEN 3 THEN p_name || ' п. сл.webp' ELSE p_name || '.jpg' END"
_TITLE = "p_name || CASE p_size % 7 WHEN 0 THEN ' Белое' WHEN 1 THEN ' красное сухое' WHEN 2 THEN ' Белое и красное' WHEN 3 THEN ' rosé' WHEN 4 THEN ' White Brut' WHEN 5 THEN ' сл.' ELSE '' END"
_SAYS = """CASE WHEN regexp_matches({0}, '(экстра\\s?брют|extra\\s?brut)') THEN 'ekstra bryut' WHEN regexp_matches({0}, '(п\\.\\s?сух|полусух|semi[\\s-]?dry)') THEN 'polusuhoe' WHEN regexp_matches({0}, '(п\\.\\s?сл|полусл|semi[\\s-]?sweet)') THEN 'polusladkoe'
  WHEN regexp_matches({0}, '(брют|brut)') THEN 'bryut' WHEN regexp_matches({0}, '(сух)') THEN 'suhoe' WHEN regexp_matches({0}, '(сладк|(^|[^\\p{{L}}])сл\\.)') THEN 'sladkoe' END"""
_COLOR_SQL = "regexp_matches(lower(title), '(^|[^\\p{{L}}])({0})([^\\p{{L}}]|$)')"
_WHITE, _RED, _ROSE = (_COLOR_SQL.format(w) for w in ("бел(ое|ый|ая)|white|blanc", "красн(ое|ый|ая)|red|rouge", "розов(ое|ый|ая)|розе|rose|rosé"))


@query(f"""WITH m AS (SELECT p_partkey, {_SLUG} AS slug, {_PHOTO} AS photo, {_TITLE} AS title FROM part), c AS (SELECT *, list_filter([CASE WHEN {_WHITE} THEN 'white' END, CASE WHEN {_RED} THEN 'red' END, CASE WHEN {_ROSE} THEN 'rose' END], lambda x: x IS NOT NULL) AS cs FROM m)
SELECT p_partkey, coalesce(CASE WHEN slug LIKE '%ekstra-bryut%' THEN 'ekstra bryut' WHEN slug LIKE '%polusuhoe%' THEN 'polusuhoe' WHEN slug LIKE '%desertn%' THEN 'desertnoe' WHEN slug LIKE 'suhoe%' THEN 'suhoe' END,
  {_SAYS.format("lower(photo)")}, {_SAYS.format("lower(title)")}, '') AS sweetness, CASE WHEN len(cs) = 1 THEN cs[1] END AS color FROM c""")
def label_categories(t):
    """Sweetness by slug, then photo, then name, and the one color that a name says."""
    d = _made(t, slug=_SLUG, photo=_PHOTO, title=_TITLE)
    return d.select("p_partkey", labels.sweetness_of(F.col("slug"), F.array("photo"), F.col("title")).alias("sweetness"), labels.text_color(F.col("title")).alias("color"))


_NAME = "p_name || CASE p_partkey % 8 WHEN 0 THEN ' Экстра брют' WHEN 1 THEN ' полусухое' WHEN 2 THEN ' Prosecco' WHEN 3 THEN ' Мускат сладкий' WHEN 4 THEN ' dry, Cava' WHEN 5 THEN ' Полусладкое игристое' WHEN 6 THEN ' Blanc de' ELSE '' END || CASE p_size % 4 WHEN 0 THEN ' ' || (1930 + p_size) WHEN 1 THEN ', 0,75 л' WHEN 2 THEN ' 1.5' ELSE '' END"
_PAGE = "replace(p_name, ' ', '-') || CASE p_size % 3 WHEN 0 THEN '-' || (1990 + p_size) WHEN 1 THEN '-polusuhoe-bryut' ELSE '-suhoe' END"
_SWEET_SQL = "CASE WHEN {0} LIKE '%экстра брют%' THEN 'extra_brut' WHEN regexp_matches({0}, '(^|[^a-z])(bryut|brut)|брют') THEN 'brut' WHEN regexp_matches({0}, '(^|[^a-z])polusuh|полусух') THEN 'semi_dry' WHEN {0} LIKE '%полуслад%' THEN 'semi_sweet' WHEN regexp_matches({0}, ' сладк') THEN 'sweet' WHEN regexp_matches({0}, '(^|[^a-z])(suh|dry)') THEN 'dry' END"


@query(f"""WITH n AS (SELECT p_partkey, lower({_NAME}) AS name, {_PAGE} AS slug FROM part), y AS (SELECT *, regexp_extract(name, '(^|[^0-9])(19[5-9][0-9]|20[0-4][0-9])([^0-9]|$)', 2) AS a, regexp_extract(slug, '(^|[^0-9])(19[5-9][0-9]|20[0-4][0-9])([^0-9]|$)', 2) AS b FROM n)
SELECT p_partkey, coalesce(nullif(a, ''), nullif(b, ''))::INT AS year, coalesce({_SWEET_SQL.format("name")}, {_SWEET_SQL.format("slug")}) AS sweetness,
  regexp_matches(name, 'брют|prosecco|cava|игристое|blanc de') OR regexp_matches(slug, 'bryut') AS sparkling, CASE WHEN name LIKE '%0,75%' THEN 0.75::DOUBLE WHEN name LIKE '%1.5' THEN 1.5 END AS volume_l FROM y""")
def name_attributes(t):
    """What names and slugs made of parts say of year, sweetness, sparkle and volume."""
    d = _made(t, name=_NAME, slug=_PAGE)
    return d.select("p_partkey", F.explode(F.array(T.attributes(F.col("name"), F.col("slug")))).alias("a")).select("p_partkey", "a.*")


# ---- words

_ROOT = "translate(split_part(p_name, ' ', {0}), 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхийклмнопярстуввхуз') || 'т'"
_SAID = f"{_ROOT.format(1)} || 'ами, ' || {_ROOT.format(2)} || 'ого ' || p_brand || ' ' || {_ROOT.format(2)} || 'ость ' || upper({_ROOT.format(1)}) || 'АЯ'"


@query(f"""WITH w AS (SELECT p_partkey, {_ROOT.format(1)} AS a, {_ROOT.format(2)} AS b, p_brand FROM part),
s AS (SELECT *, CASE WHEN regexp_matches(b, '^[^аеиоуыэюя]*[аеиоуыэюя]+[^аеиоуыэюя]+[аеиоуыэюя]+[^аеиоуыэюя]') THEN b ELSE b || 'ост' END AS c FROM w)
SELECT p_partkey, array_to_string([a, b, lower(split_part(p_brand, '#', 1)), split_part(p_brand, '#', 2), c, a], ' ') AS stems FROM s WHERE NOT regexp_matches(a || b, '(ост|ейш)т?$') AND regexp_matches(a, '[аеиоуыэюя].') AND regexp_matches(b, '[аеиоуыэюя].')""")
def russian_stems(t):
    """Stems of words that parts' names make in Cyrillic letters, with endings of nouns and adjectives and one that derives."""
    d = _made(t, said=_SAID, a=_ROOT.format(1), b=_ROOT.format(2))
    vowel = "[аеиоуыэюя]."
    d = d.filter(~F.concat("a", "b").rlike("(ост|ейш)т?$") & F.col("a").rlike(vowel) & F.col("b").rlike(vowel))
    return d.select("p_partkey", F.array_join(T.words(F.col("said")), " ").alias("stems"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 60 + p_partkey % 60 WHEN 1 THEN p_size WHEN 2 THEN p_size * 3600 END::DOUBLE AS seconds, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS width, p_name || ' ' || p_type AS plain,
  CASE WHEN p_size % 5 BETWEEN 1 AND 3 AND p_partkey % 7 BETWEEN 1 AND 3 AND p_size % 5 <> p_partkey % 7 THEN (p_size % 5) || ',' || (p_partkey % 7) WHEN p_size % 5 BETWEEN 1 AND 3 THEN (p_size % 5)::VARCHAR WHEN p_partkey % 7 BETWEEN 1 AND 3 THEN (p_partkey % 7)::VARCHAR ELSE '1,2,3' END AS cited,
  CASE WHEN p_partkey % 10 = 1 AND p_partkey % 100 <> 11 THEN 'год' WHEN p_partkey % 10 BETWEEN 2 AND 4 AND p_partkey % 100 NOT BETWEEN 12 AND 14 THEN 'года' ELSE 'лет' END AS age_word FROM part WHERE p_size > 0""")
def small_scalars(t):
    """Durations, sizes, squeezed blanks, citations and plural forms of parts' numbers and names."""
    d = _made(
        t, length="CASE p_partkey % 4 WHEN 0 THEN p_size || 'm' || p_partkey % 60 || 's' WHEN 1 THEN ' ' || p_size WHEN 2 THEN p_size || ' H' ELSE p_size || 'x' END",
        size="CASE p_partkey % 3 WHEN 0 THEN ' ' || p_size || 'X' || p_partkey WHEN 1 THEN p_size || '' ELSE 'ax' || p_size END", wide="'  ' || p_name || '   ' || p_type || ' '",
        said="'see [' || p_size % 5 || '], [' || p_partkey % 7 || '] [9]'", n="p_size",
    ).filter("n > 0")
    cited = T.citations(F.col("said"), F.lit(3))
    return d.select(
        "p_partkey", S.seconds_of(F.col("length")).alias("seconds"), S.size_of(F.col("size")).width.alias("width"), T.squeeze(F.col("wide")).alias("plain"),
        F.array_join(cited, ",").alias("cited"), S.plural(F.col("p_partkey"), "год", "года", "лет").alias("age_word"),
    )


@query("""WITH n AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_type, p_brand FROM part), k AS (SELECT DISTINCT lower(p_type) AS w, lower(p_type) || '-card' AS card FROM part UNION SELECT DISTINCT b, b || '-card' FROM n),
l AS (SELECT id, list_concat([p_type], CASE WHEN id % 3 = 0 THEN [p_type, b] WHEN id % 3 = 1 THEN [p_brand || ' и ' || b] ELSE [] END, CASE WHEN id % 2 = 1 THEN [b] WHEN a IN (SELECT w FROM k) THEN [a] ELSE [a || ' (' || b || ')'] END) AS names FROM n)
SELECT id, array_to_string(names, '|') AS names, (SELECT count(*) FROM (SELECT unnest(l.names) AS x) JOIN k ON k.w = lower(x))::INT AS known FROM l""")
def grape_lists(t):
    """Lists of names made ready for lookup: brackets, joint names, ignored and blank ones; and how many of them are known."""
    p = t("part").withColumn("a", F.split_part("p_name", F.lit(" "), F.lit(1))).withColumn("b", F.split_part("p_name", F.lit(" "), F.lit(2)))
    joint = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("  и "), "b", F.lit(" (x)"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_brand", F.lit(" и "), "b")).otherwise(" ")
    last = F.when(F.col("p_partkey") % 2 == 0, F.concat("a", F.lit(" ("), "b", F.lit(")"))).otherwise(F.concat("b", F.lit(" (old)")))
    rows = p.select("p_partkey", F.array(F.concat(F.lit(" "), "p_type"), F.lit("Any Kind"), joint, last).alias("names"))
    words = p.select(F.upper("p_type").alias("word"), F.concat(F.lower("p_type"), F.lit("-card")).alias("card")).unionByName(p.select(F.col("b").alias("word"), F.concat("b", F.lit("-card")).alias("card"))).distinct()
    made = matching.expand_names(rows, "p_partkey", "names", words, rows.limit(1).select(F.lit("any kind").alias("word")))
    one = matching.resolve_synonyms(made.select("id", F.explode("names").alias("name")), "name", words)
    known = one.groupBy("id").agg(F.count("card").cast("int").alias("known"))
    return made.join(known, "id").select("id", F.array_join("names", "|").alias("names"), "known")


# ---- profiles

_SUGAR = "CASE p_size % 7 WHEN 0 THEN 'Сухое' WHEN 1 THEN 'экстра брют' WHEN 2 THEN 'брют' WHEN 3 THEN 'полусухое' WHEN 4 THEN 'полусладкое' WHEN 5 THEN 'сладкое' END"
_TONE = "CASE p_partkey % 5 WHEN 0 THEN 'Красное' WHEN 1 THEN 'белое' WHEN 2 THEN 'розовое' WHEN 3 THEN 'оранжевое' END"
_TALE = "p_name || CASE p_partkey % 4 WHEN 0 THEN ', в дубе' WHEN 1 THEN ', Barrique' WHEN 2 THEN ' пет-нат' ELSE '' END"


@query(f"""WITH b AS (SELECT p_partkey, lower(coalesce({_SUGAR}, '')) AS sugar, lower(coalesce({_TONE}, '')) AS color, lower({_TALE}) AS said, CASE WHEN p_size % 2 = 0 THEN p_size / 50.0::DOUBLE END AS ta, CASE WHEN p_size % 3 = 0 THEN p_size / 40.0::DOUBLE END AS bo,
  CASE WHEN p_size % 5 > 0 THEN p_partkey % 10 / 10.0::DOUBLE END AS ac, CASE WHEN p_size % 4 = 1 THEN p_partkey % 8 / 8.0::DOUBLE END AS ar, CASE WHEN p_size % 6 > 1 THEN 9 + p_size / 10.0::DOUBLE END AS abv FROM part),
f AS (SELECT *, CASE sugar WHEN 'экстра брют' THEN 0.02::DOUBLE WHEN 'брют' THEN 0.08 WHEN 'сухое' THEN 0.05 WHEN 'полусухое' THEN 0.30 WHEN 'полусладкое' THEN 0.55 WHEN 'сладкое' THEN 0.85 END AS sweet, contains(sugar, 'брют') OR contains(said, 'пет-нат') AS bub, contains(said, 'дуб') OR contains(said, 'barrique') AS oak,
  least(coalesce(round(ta, 3), CASE color WHEN 'красное' THEN 0.55 WHEN 'оранжевое' THEN 0.5 ELSE 0.05 END), CASE color WHEN 'белое' THEN 0.10 WHEN 'розовое' THEN 0.20 WHEN 'оранжевое' THEN 0.60 ELSE 1 END)::DOUBLE AS tan,
  least(coalesce(round(bo, 3), CASE color WHEN 'красное' THEN 0.65 WHEN 'оранжевое' THEN 0.6 WHEN 'розовое' THEN 0.4 ELSE 0.45 END), CASE color WHEN 'белое' THEN 0.80 WHEN 'розовое' THEN 0.65 ELSE 1 END)::DOUBLE AS bod FROM b)
SELECT p_partkey, sweet AS sweetness, round(ac, 3) AS acidity, tan AS tannin, CASE WHEN abv IS NOT NULL THEN round(least(1.0::DOUBLE, bod + (abv - 12.0::DOUBLE) * 0.03::DOUBLE), 3) ELSE bod END AS body, CASE WHEN oak THEN 0.6 ELSE 0.1 END::DOUBLE AS oak, round(ar, 3) AS aromatic,
  CASE WHEN bub THEN 0.6 ELSE 0 END::DOUBLE AS bubbles, round_even(least(1.0::DOUBLE, ((sweet IS NOT NULL)::INT + bub::INT + oak::INT + (ac IS NOT NULL)::INT + (ta IS NOT NULL)::INT + (bo IS NOT NULL)::INT + (ar IS NOT NULL)::INT) / 6.0::DOUBLE), 2) AS confidence FROM f""")
def sensory_profiles(t):
    """The axes of cards made of parts, and how many of them were really derived."""
    d = t("part").select("p_partkey", "p_size", F.expr(_SUGAR).alias("sugar"), F.expr(_TONE).alias("color"), F.explode(F.array(F.expr(_TALE))).alias("said"))
    size, key = F.col("p_size"), F.col("p_partkey")
    profile = F.struct(
        F.when(size % 5 > 0, key % 10 / 10.0).alias("acidity"), F.when(size % 2 == 0, size / 50.0).alias("tannin"), F.when(size % 3 == 0, size / 40.0).alias("body"), F.when(size % 4 == 1, key % 8 / 8.0).alias("aromatic_intensity")
    )
    d = d.select("p_partkey", "sugar", "color", "said", F.explode(F.array(profile)).alias("profile"), F.when(size % 6 > 1, 9 + size / 10.0).alias("abv"))
    s = recommend.sensory(F.col("sugar"), F.col("said"), F.col("color"), F.col("profile"), F.col("abv"))
    named = ("sweetness", "acidity", "tannin", "body", "oak", "aromatic_intensity", "bubbles", "confidence")
    return d.select("p_partkey", s.alias("s")).select("p_partkey", *[F.col(f"s.{n}").alias(n.removesuffix("_intensity")) for n in named])


_ENTRY = "CASE p_partkey % 4 WHEN 0 THEN 'a glass of ' || p_name || ', ' || p_type WHEN 1 THEN 'some ' || p_type || ' ' || p_size WHEN 2 THEN 'the ' || p_type || 'q here' ELSE 'nothing at all' END"


@query("""WITH a AS (SELECT DISTINCT p_name FROM part WHERE length(p_name) % 2 = 0), k AS (SELECT DISTINCT lower(p_type) AS w FROM part)
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN coalesce(replace(a.p_name, ' ', '-'), (SELECT w FROM k WHERE w = split_part(p.p_name, ' ', 1)), (SELECT w FROM k WHERE w = split_part(p.p_name, ' ', 2)), lower(p_type)) ELSE lower(p_type) END AS slug, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN a.p_name IS NULL THEN 1 ELSE 0 END ELSE p_partkey % 4 END::INT AS step
FROM part p LEFT JOIN a ON a.p_name = p.p_name WHERE p_partkey % 4 < 3""")
def dictionary_phrases(t):
    """Entries that texts made of parts name: by two words, by one, by one with a letter wrong; a fourth names none."""
    p = t("part")
    two = p.filter(F.length("p_name") % 2 == 0).select(F.initcap("p_name").alias("phrase"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"))
    known = two.unionByName(p.select(F.col("p_type").alias("phrase"), F.lower("p_type").alias("slug"))).distinct()
    return P.phrases_found(_made(t, text=_ENTRY).withColumnRenamed("p_partkey", "id"), known)


# ---- questions

_QUESTION = """CASE p_partkey % 12 WHEN 0 THEN 'Расскажите про ' || p_name || ' от ' || p_brand WHEN 1 THEN 'Где винодельня ' || p_name || '?' WHEN 2 THEN 'Что такое ' || p_name WHEN 3 THEN 'Красное вино к ' || p_name WHEN 4 THEN p_name || ' к ' || p_type
  WHEN 5 THEN 'Белое полусухое ' || p_name WHEN 6 THEN '' WHEN 7 THEN 'Что подать: ' || p_name || ' или ' || p_type || ' из региона Крым, розовое экстра-брют?' WHEN 8 THEN 'Чем отличается брют ' || p_name WHEN 9 THEN 'Из Долины Дона, ' || p_name WHEN 10 THEN NULL ELSE p_name || ' под ' || p_type || ' и ещё много слов о том, чего хочется' END"""
_B, _E = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
_REGIONS = {"krym": "Крым", "don": "Долина Дона", "kuban": "Кубань"}


@query(rf"""WITH q AS (SELECT p_partkey, lower(trim(coalesce({_QUESTION}, ''))) AS q, {_QUESTION} IS NULL AS blank FROM part),
f AS (SELECT *, CASE WHEN blank THEN NULL WHEN regexp_matches(q, '{_B}красн') THEN 'красное' WHEN regexp_matches(q, '{_B}бел') THEN 'белое' WHEN regexp_matches(q, '{_B}розов') THEN 'розовое' WHEN regexp_matches(q, '{_B}оранж') THEN 'оранжевое' END AS color,
  CASE WHEN blank THEN NULL WHEN regexp_matches(q, '{_B}экстра.?брют') THEN 'экстра брют' WHEN regexp_matches(q, '{_B}полусух') THEN 'полусухое' WHEN regexp_matches(q, '{_B}полуслад') THEN 'полусладкое' WHEN regexp_matches(q, '{_B}брют') THEN 'брют' WHEN regexp_matches(q, '{_B}сух') THEN 'сухое' WHEN regexp_matches(q, '{_B}сладк') THEN 'сладкое' END AS sugar,
  CASE WHEN blank THEN NULL WHEN regexp_matches(q, '{_B}крым') THEN 'krym' WHEN regexp_matches(q, '{_B}(долин|дон)') THEN 'don' WHEN regexp_matches(q, '{_B}кубан') THEN 'kuban' END AS region FROM q),
i AS (SELECT *, CASE WHEN q = '' THEN 'default' WHEN regexp_matches(q, '^расскаж.{{0,3}}\s+про\s+.+\s+от\s+.+') THEN 'pairing'
  WHEN regexp_matches(q, 'винодельн|вино.?тур|винный тур|экскурси|куда (съездить|поехать)|путешеств|посетить|дегустационн.?(зал|комнат)') THEN 'travel'
  WHEN regexp_matches(q, '^что такое|^почему|^откуда|^как называ|^зачем|что означает|в чём разниц|чем отлича|из чего (сделан|образ)|расскаж.{{0,3}} про|как понять') THEN 'fact'
  WHEN regexp_matches(q, 'вин[оаеуы]{_E}|что (подать|взять|выбрать|заказать){_E}') OR (length(q) <= 30 AND regexp_matches(q, '{_B}(к|под)\s+\S')) OR color IS NOT NULL OR sugar IS NOT NULL OR region IS NOT NULL THEN 'pairing' ELSE 'default' END AS intent FROM f)
SELECT p_partkey, intent, CASE intent WHEN 'travel' THEN 'wineries,knowledge' WHEN 'fact' THEN 'knowledge' WHEN 'pairing' THEN 'wines' ELSE 'wines,knowledge' END AS collections, color, coalesce(CASE WHEN p_partkey % 7 = 0 THEN 'сухое' END, sugar) AS sugar, region FROM i""")
def intent_routing(t):
    """Intent, collections and filters of questions about parts; a seventh asks for dry wine in a field of its own, which doesn't change the intent here."""
    asked = _made(t, text=_QUESTION).withColumn("found", I.extracted_filters(F.col("text"), _REGIONS))
    fields = ["color", "sugar", "region"]
    explicit = F.struct(F.lit(None).cast("string").alias("color"), F.when(F.col("p_partkey") % 7 == 0, "сухое").alias("sugar"), F.lit(None).cast("string").alias("region"))
    intent = I.intent(F.col("text"), I.filters_active(F.col("found"), fields))
    asked = asked.select("p_partkey", I.merged_filters(explicit, F.col("found"), fields).alias("m"), intent.alias("intent"))
    return asked.select("p_partkey", "intent", F.array_join(I.collections(F.col("intent")), ",").alias("collections"), "m.*")


# ---- files and records


@query("""WITH f AS (SELECT p_brand AS grp, p_partkey AS file, p_size % 4 AS base, p_partkey % 9 = 0 AS lone, p_retailprice AS score FROM part)
SELECT grp AS "group", file, CASE WHEN lone THEN file ELSE first_value(file) OVER (PARTITION BY grp, base, lone ORDER BY score DESC, file) END AS root FROM f""")
def content_groups(t):
    """Files of a group whose hashes are a few bits apart, and the best of them; a ninth has hashes far from all."""
    base = F.conv(F.substring(F.md5((F.col("p_size") % 4).cast("string")), 1, 15), 16, 10).cast("long")
    bit = lambda m: F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p_partkey") % m).cast("int"))
    near = base.bitwiseXOR(bit(60)).bitwiseXOR(bit(7)).bitwiseXOR(bit(11))
    alone = F.xxhash64(F.lit("alone"), "p_partkey")
    f = t("part").select(
        F.col("p_brand").alias("group"), F.col("p_partkey").alias("file"), F.col("p_partkey").cast("string").alias("digest"), F.when(F.col("p_partkey") % 9 == 0, alone).otherwise(near).alias("bits"),
        F.col("p_retailprice").alias("score"), F.lit(0).alias("area"), F.lit(0).alias("mtime"),
    )
    return matching.content_groups(f, "group")


@query("""SELECT o_custkey AS user, o_orderdate::TIMESTAMP AS ts, 'order' AS kind, o_orderkey AS id, o_totalprice AS amount, NULL AS said FROM orders UNION ALL SELECT user_id, ts, 'event', event_id, value, event_type FROM events""")
def exported_records(t):
    """All rows of all users, from both tables, as records; read out of these again."""
    o = t("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    e = t("events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("amount"), F.col("event_type").alias("said"))
    out = P.exported({"order": o, "event": e}, "user_id", "ts")
    r = F.from_json("record", "user_id long, id long, amount double, said string")
    return out.select("user", "ts", "kind", r.alias("r")).filter("r.user_id = user").select("user", "ts", "kind", "r.id", "r.amount", "r.said")
