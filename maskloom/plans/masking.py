"""Queries over detection, union, numbering, masking and restoration, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import categories as C
from maskloom.functions import native as N
from maskloom.operators import labels as L
from maskloom.operators import masking
from maskloom.operators import spans as S
from maskloom.operators import verify as V
from maskloom.operators.rounds import kept


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(table: str, key: str, text: str, pattern: str, keep=None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, table)
        found = N.match_spans(F.col(text), pattern)
        return docs.where(F.col(text).isNotNull()).select(key, F.explode(F.filter(found, keep) if keep else found).alias("s")).select(
            key, F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"), "s.value"
        )

    return query


def matches_sql(table: str, key: str, text: str, pattern: str, extra: str = "") -> str:
    """All matches with positions and neighbours, in DuckDB."""
    p = pattern.replace("'", "''")
    return f"""select {key}, st::bigint as "start", (st + length(m))::bigint as "stop", m as value, right(gaps[i], 1) as before, left(gaps[i + 1], 1) as after{extra} from (
  select *, ms[i] as m, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0) as st from (
    select *, unnest(generate_series(1, len(ms))) as i from (
      select *, regexp_extract_all({text}, '{p}', 0) as ms, string_split_regex({text}, '{p}') as gaps from {table} where regexp_matches({text}, '{p}'))))"""


_ALONE = "not regexp_matches(before, '[A-Za-z0-9_-]') and not regexp_matches(after, '[A-Za-z0-9_-]')"
_IDS = "case length(value) " + " ".join(f"when {k} then '{v}'" for k, v in N.DIGIT_IDS.items()) + " end"
_PRIO = "case category " + " ".join(f"when '{k}' then {v}" for k, v in C.PRIORITY.items()) + " end"
_RAW = f"""raw as (
  select doc_id, "start", "stop", 'EMAIL' as category, 40 as ord from ({matches_sql('documents', 'doc_id', 'text', N.EMAIL)})
  union all select doc_id, "start", "stop", 'ТЕЛЕФОН', 41 from ({matches_sql('documents', 'doc_id', 'text', N.PHONE)})
  union all select doc_id, "start", "stop", {_IDS}, 50 from ({matches_sql('documents', 'doc_id', 'text', N.DIGITS)}) where {_ALONE} and {_IDS} is not null)"""
_UNITED = f"""{_RAW},
p as (select *, {_PRIO} as priority from raw),
i as (select *, sum(apart) over (partition by doc_id order by "start", "stop" desc, ord rows unbounded preceding) as island from (
  select *, case when "start" < max("stop") over (partition by doc_id order by "start", "stop" desc, ord rows between unbounded preceding and 1 preceding) then 0 else 1 end as apart from p)),
u as (select doc_id, island, min("start") as "start", max("stop") as "stop", first(category order by priority desc, "start", "stop" desc, ord) as category from i group by doc_id, island),
v as (select u.doc_id, u."start", u."stop", u.category, substr(d.text, u."start" + 1, u."stop" - u."start") as value from u join documents d using (doc_id)),
f as (select *, min("start") over (partition by doc_id, category, value) as first_at from v),
n as (select doc_id, "start", "stop", category, value, dense_rank() over (partition by doc_id, category order by first_at) as n from f)"""
_MASKED = f"""{_UNITED},
m as (select doc_id, "start", "stop", '[' || category || '_' || n || ']' as label, coalesce(lag("stop") over (partition by doc_id order by "start"), 0) as "from", row_number() over (partition by doc_id order by "start" desc) as k from n),
t as (select m.doc_id, string_agg(substr(d.text, m."from" + 1, m."start" - m."from") || m.label, '' order by m."start") || substr(d.text, max(m."stop") + 1) as masked, count(*) as n_spans from m join documents d using (doc_id) group by m.doc_id, d.text),
a as (select d.doc_id, coalesce(t.masked, d.text, '') as masked, coalesce(t.n_spans, 0) as n_spans from documents d left join t using (doc_id))"""

_BARE = _MASKED.replace("category || '_' || n || ']' as label", "category || ']' as label")


def span_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = S.as_segments(read(spark, sf_dir, "documents"))
    spans = S.exploded(S.with_spans(segments))
    return spans.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "category", "value")


def span_union_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by windows, for spans that come from several sources as rows."""
    spans = S.united(S.detected(S.as_segments(read(spark, sf_dir, "documents"))))
    return spans.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "category")


def anonymize_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked turns of conversations, numbered through each conversation; every tenth turn gets an address to mask."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_no"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" user"), (F.col("turn") % 3).cast("string"), F.lit("@example.com"))).otherwise("")).alias("text"))
    masked, _ = L.anonymized(turns)
    return masked.select(F.col("doc_id").alias("conv_id"), F.col("seg_no").alias("turn"), F.col("text").alias("masked"))


def label_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = S.as_segments(read(spark, sf_dir, "documents"))
    spans = L.numbered(S.exploded(S.with_spans(segments)))
    return L.label_table(spans).select("doc_id", "category", F.col("n").cast("long").alias("n"), "label", "value")


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering over the turns of a conversation: capitalised words at the start of a line stand for names."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_no"), F.coalesce("text", F.lit("")).alias("text"))
    found = N.match_spans(F.col("text"), "[A-Z][a-z]{3,}")
    spans = turns.select("doc_id", "seg_no", F.explode(found).alias("s")).select("doc_id", "seg_no", "s.start", "s.stop", F.lit(C.PERSON).alias("category"), "s.value")
    return L.label_table(L.numbered(spans)).select(F.col("doc_id").alias("conv_id"), F.col("n").cast("long").alias("n"), "label", "value")


def anonymize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = L.anonymized_rows(read(spark, sf_dir, "documents"))
    return masked.select("doc_id", "masked", F.size("spans").cast("long").alias("n_spans"))


def anonymize_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with bare categories in place of numbered labels."""
    return L.anonymized_rows(read(spark, sf_dir, "documents"), numbered=False).select("doc_id", "masked")


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are masked once; what is restored is held against the digest of the original."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    masked = kept(L.anonymized_rows(docs, digest=F.sha2(F.coalesce("text", F.lit("")), 256)))
    labels = masked.where(F.size("spans") > 0).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.category", "s.n", "s.value").distinct()
    back = L.restored(masked.select("doc_id", F.col("masked").alias("text")), labels)
    return back.join(masked.select("doc_id", "digest"), "doc_id").select("doc_id", "restored", "unresolved", (F.sha2("text", 256) == F.col("digest")).alias("equal"), F.sha2("text", 256).alias("text_sha256"))


def restore_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text cut into 1 to 40 pieces, each piece the value of a label that leads to the next, and restored from the first label.
    In every tenth document the last label leads back, so that a part of the chain is circular and stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    depth = (F.col("doc_id") % 40 + 1).cast("int")
    rows = docs.select("doc_id", "text", depth.alias("depth"), F.floor(F.length("text") / depth).cast("int").alias("size"), F.when(F.col("doc_id") % 10 == 3, F.col("doc_id") % 7 % depth + 1).alias("back"))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(1), "depth")).alias("n"))
    piece = F.when(F.col("n") < F.col("depth"), F.substring(F.col("text"), (F.col("n") - 1) * F.col("size") + 1, F.col("size"))).otherwise(F.substring(F.col("text"), (F.col("n") - 1) * F.col("size") + 1, F.length("text")))
    next_ = F.when(F.col("n") < F.col("depth"), F.col("n") + 1).otherwise(F.col("back").cast("int"))
    value = F.concat(piece, F.when(next_.isNull(), "").otherwise(N.label(F.lit(C.PROJECT), next_)))
    labels = pieces.select("doc_id", F.lit(C.PROJECT).alias("category"), "n", value.alias("value"))
    back = L.restored(docs.select("doc_id", N.label(F.lit(C.PROJECT), F.lit(1)).alias("text")), labels)
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "restored", "unresolved", "circular")


def circular_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as labels of their nation whose values name another customer: which of them lead back to themselves."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("n"))
    value = F.concat(F.lit("see "), N.label(F.lit(C.PERSON), F.when(F.col("n") % 11 == 0, F.col("n") - 250).otherwise(F.col("n") + 25)))
    return L.circular_labels(rows.select((F.col("n") % 25).alias("doc_id"), F.lit(C.PERSON).alias("category"), "n", value.alias("value")))


def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of three characters or more that an output still holds: here only each document's first value was masked."""
    masked = L.anonymized_rows(read(spark, sf_dir, "documents")).where(F.size("spans") > 0)
    labels = masked.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.value")
    texts = read(spark, sf_dir, "documents").join(masked.select("doc_id", "spans"), "doc_id")
    first = N.spliced(F.col("text"), F.slice("spans", 1, 1), lambda s: N.label(s["category"], s["n"]))
    return V.residual_values(texts.select("doc_id", first.alias("text")), labels)


def unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of an answer that its document's table lacks though it knows the category. The answers go on counting: to the masked text
    they add the label that follows each of its labels."""
    masked = L.anonymized_rows(read(spark, sf_dir, "documents"))
    labels = masked.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.category", N.label(F.col("s.category"), F.col("s.n")).alias("label")).distinct()
    more = F.array_join(F.transform("spans", lambda s: N.label(s["category"], s["n"] + 1)), " ")
    return V.unknown_labels(masked.select("doc_id", F.concat_ws(" ", "masked", more).alias("text")), labels)


def redaction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct trimmed values of three characters or more, in the order in which a document first shows them."""
    spans = L.anonymized_rows(read(spark, sf_dir, "documents")).where(F.size("spans") > 0).select("doc_id", F.explode("spans").alias("s"))
    first = spans.select("doc_id", F.trim("s.value").alias("value"), "s.start").where(F.length("value") >= 3).groupBy("doc_id", "value").agg(F.min("start").alias("at"))
    from pyspark.sql import Window

    return first.select("doc_id", "value", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).cast("long").alias("place"))


def pii_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    spans = docs.select("lang", "source", F.explode(N.neutral_spans(F.coalesce("text", F.lit("")))).alias("s")).select("lang", "source", "s.category")
    return spans.cube("lang", "source", "category").agg(F.count("*").alias("n"))


def smart_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section switches over lines; English markers stand in for the Russian ones, which the tables lack."""
    on = S.switched(S.lines_of(read(spark, sf_dir, "documents")), off=("and ",), on=("the ", "der "))
    return on.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("masking").alias("masked_lines"))


def _k(width: int, fill: str) -> str:
    return f"lpad(cast(c_custkey as varchar(20)), {width}, '{fill}')"


#: Texts for groups of rules: literals, and (SQL of a value, its category) for what must be found. Both engines read the SQL alike.
RULE_TEXTS = {
    "rules_identifiers": ["ИНН ", (_k(10, "7"), C.INN_COMPANY), ", КПП ", (_k(9, "5"), C.KPP), "; ИНН физического лица ", (_k(12, "6"), C.INN_PERSON), "; ОГРН ", (_k(13, "1"), C.OGRN), "; ОГРНИП ", (_k(15, "3"), C.OGRN), "; р/с ", (_k(20, "4"), C.ACCOUNT), "; БИК банка ", (f"concat('04', {_k(7, '3')})", C.BIK), "; СНИЛС ", (f"concat('001-002-', {_k(3, '0')}, ' 04')", C.SNILS), "; участок ", (f"concat('78:10:', {_k(7, '0')}, ':12')", C.CADASTRE), "; запись ", (f"concat('77:01:', {_k(7, '0')}, ':1234 - 77/001/2020-55')", C.EGRN), "; индекс ", (_k(6, "1"), C.INDEX)],
    "rules_papers": ["Договор № ", (f"concat({_k(4, '0')}, '-П/22')", C.DOC_NO), "; паспорт ", (f"concat('4011 ', {_k(6, '1')})", C.PASSPORT), ", выдан ", ("'ФМС по г. Пскову'", C.PASSPORT_ISSUED), ", код подразделения ", (f"concat('780-', {_k(3, '0')})", C.DIV_CODE), ", дата выдачи: ", ("'05.06.2010'", C.ISSUE_DATE), "; ", ("concat(lpad(cast(c_custkey % 28 + 1 as varchar(2)), 2, '0'), '.02.1990')", C.BIRTH_DATE), " г.р."],
    "rules_money": ["цена ", ("concat(cast(c_custkey % 900 + 100 as varchar(9)), ' 500,00')", C.MONEY), " руб., аванс ", ("cast(c_custkey % 90 + 10 as varchar(9))", C.MONEY), " у.е., пени ", ("cast(c_custkey % 9000 + 1000 as varchar(9))", C.MONEY), " долл. США (", ("'Пятьсот рублей 00 копеек'", C.MONEY), "), итого € ", ("cast(c_custkey % 90 + 10 as varchar(9))", C.MONEY)],
    "rules_people": ["Договор подписал ", ("case c_custkey % 4 when 0 then 'Сидоров Антон Борисович' when 1 then 'Банков Пётр Ильич' when 2 then 'СИДОРОВ А.Б.' else 'Петрова Анна Ивановна' end", C.PERSON), " от имени ООО ", (f"concat('«Василёк ', {_k(5, '0')}, '»')", C.ORG), " и КФХ ", ("'«Нива»'", C.ORG), "; почта ", (f"concat('user', {_k(5, '0')}, '@пример.рф')", C.EMAIL), ", тел. ", (f"concat('+7 921 555-', {_k(2, '0')}, '-34')", C.PHONE), " или ", ("'(812) 555-12-34'", C.PHONE)],
    "rules_places": ["этаж ", ("cast(c_custkey % 9 + 1 as varchar(2))", C.ADDRESS), ", помещение ", ("cast(c_custkey % 900 + 1 as varchar(9))", C.ADDRESS), ", корп. ", ("'IV'", C.ADDRESS), ", подъезд ", ("cast(c_custkey % 9 + 1 as varchar(2))", C.ADDRESS), ", кв. ", (f"concat({_k(3, '1')}, 'а')", C.ADDRESS)],
}


#: A line for each document, by its number: literals, and (SQL of a value, the rules that find it). ``n`` has five digits.
SENTENCES = [
    ["проект ", ("concat('«Заря ', n, '»')", "project"), "; ООО ", ("concat('«Василёк ', n, '»')", "org_form"), "; Банк ", ("'\"Восток\"'", "org_form"), "."],
    ["Подписали ", ("'ИП '+'Сидоров А.Б.'", "sole_trader_initials|surname_initials"), " и ", ("'Индивидуальный предприниматель '+'Петров Пётр Ильич'", "sole_trader_full|surname_given_patronymic"), ";"],
    ["Присутствуют ", ("'Сидоров Антон Борисович'", "surname_given_patronymic"), ", ", ("'Антон Борисович Сидоров'", "given_patronymic_surname"), ", ", ("'Петрова А.И.'", "surname_initials"), " и ", ("'В.Г. Кузнецов'", "initials_surname"), "."],
    ["участок ", ("concat('78:10:00', n, ':12')", "cadastre"), ", прежний ", ("concat('78-01/', right(n, 4), '-17')", "register_number"), "."],
    ["паспорт ", ("concat('4011 '+'2', n)", "passport|postal_index"), ", выдан ", ("'ФМС по г. Пскову'", "passport_issued"), ", код подразделения ", ("concat('780-', right(n, 3))", "division_code"), ", дата выдачи: ", ("'05.06.2010'", "issue_date,date"), "."],
    ["серия ", ("concat('40 11 № '+'2', n)", "passport_series|document_number,postal_index"), "; СНИЛС ", ("concat('001-002-', right(n, 3), ' 04')", "snils"), "; дата рождения: ", ("'17.02.1990'", "birth_date,date"), "; ", ("'18.02.1990'", "born,date"), " г.р."],
    ["Место рождения: ", ("'г. Ленинград'", "birth_place"), "; этаж ", ("'17'", "building_part"), ", корп. ", ("'IV'", "building_part"), ";"],
    ["Зарегистрирован по адресу: ", ("concat('Псков, Рижский проспект, ', n)", "registered_at")],
    ["Адрес регистрации: ", ("concat('Псков, Рижский проспект, ', n)", "registration_address")],
    ["Почтовый адрес: ", ("concat('Псков, Рижский проспект, ', n)", "labelled_address"), "; ", ("'г. Рославль, ул. Садовая, д. '+'17'", "street_address|building_part"), ";"],
    ["р/с ", ("concat('444444444444444', n)", "account,bare_account"), "; ОГРН ", ("concat('11111111', n)", "ogrn,bare_ogrn"), "; ОГРНИП ", ("concat('3333333333', n)", "ogrn,bare_ogrnip"), ";"],
    ["ИНН физического лица ", ("concat('6666666', n)", "inn_person,bare_inn_person"), "; ИНН ", ("concat('77777', n)", "inn_company,bare_inn_company"), ", КПП ", ("concat('5555', n)", "kpp"), ", БИК банка ", ("concat('0433', n)", "bik,bare_bik"), ";"],
    ["SWIFT: ", ("'ABCDRUMM'", "swift,latin_org"), "; подписал ", ("'СИДОРОВ АНТОН БОРИСОВИЧ'", "caps_name"), ", затем ", ("'ПЕТРОВ А.Б.'", "caps_surname_initials"), " и ", ("'В.Г. КУЗНЕЦОВ'", "initials_caps_surname"), ";"],
    [("concat('user', n, '@пример.рф')", "email"), ", ", ("'(812) '+'555-12-34'", "phone_brackets|phone_short"), ", ", ("'555-12-35'", "phone_short"), ", дело ", ("concat('222222', n)", "bare_number_11"), " и ", ("concat('222222222', n)", "bare_number_14"), ";"],
    ["Договор № ", ("concat(right(n, 4), '-П/22')", "document_number"), "; приложение № 2; ГОСТ 21.10; аванс ", ("'17'", "money"), " у.е.; итого € ", ("'18'", "money_sign"), " (", ("'Пятьсот рублей 00 копеек'", "money_words"), ") и ", ("'12 500 000'", "money_grouped"), ", индекс ", ("concat('2', n)", "postal_index"), "."],
    ["ОБРАБОТКА ДАННЫХ от ", ("'17.03.2020'", "date"), " сумма ", ("'17.50'", "money_decimal"), ", тел. ", ("'+7-921-555-1234'", "phone"), ", по ст. 12.10, ноль 0.00, ООО ", ("'«Лес»'", "org_form"), ", ", ("'Globex'", "latin_org"), " 1; ", ("'Initech GmbH'", "latin_org"), ";"],
]


def _sentence(number: int) -> tuple[str, list[tuple[str, str, str, str]]]:
    """SQL of the line, and (SQL of the start, of the stop, rule, SQL of the value) of all it holds. A value of two parts ('a'+'b'), with
    rules of the whole and of its second part (whole|second)."""
    at, made, found = "0", [], []
    for piece in SENTENCES[number]:
        if isinstance(piece, str):
            sql = f"'{piece}'"
        else:
            sql = piece[0].replace("'+'", "")
            whole, _, second = piece[1].partition("|")
            found += [(at, f"{at} + length({sql})", rule, sql) for rule in whole.split(",")]
            if second:
                part = piece[0].partition("'+'")[2]
                part = f"concat('{part}" if piece[0].startswith("concat") else f"'{part}"
                found += [(f"{at} + length({sql}) - length({part})", f"{at} + length({sql})", rule, part) for rule in second.split(",")]
        made.append(sql)
        at = f"{at} + length({sql})"
    return f"concat({', '.join(made)})", found


def rules_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules by name over whole documents that end in a line made for them; of what is found, that line's part, which SQL knows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr("lpad(cast(doc_id % 100000 as string), 5, '0')").alias("n"))
    line = F.element_at(F.array(*(F.expr(_sentence(k)[0]) for k in range(len(SENTENCES)))), (F.col("doc_id") % len(SENTENCES) + 1).cast("int"))
    found = masking.rules_found(docs.select("doc_id", F.concat("text", F.lit("\n"), line).alias("text")), dates=True)
    lengths = docs.select("doc_id", F.length("text").alias("length"))
    return found.join(lengths, "doc_id").where("start > length").select("doc_id", "rule", "start", "stop", "value")


def _rules_documents_sql() -> str:
    each = []
    for k in range(len(SENTENCES)):
        each += [f"""select doc_id, '{rule}' as rule, length + 1 + {a} as "start", length + 1 + {z} as "stop", {v} as value from d where doc_id % {len(SENTENCES)} = {k}""" for a, z, rule, v in _sentence(k)[1]]
    return f"""with d as (select doc_id, length(coalesce(text, ''))::bigint as length, lpad((doc_id % 100000)::varchar, 5, '0') as n from documents)
{' union all '.join(each)}"""


def _rules(pieces: list):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = ", ".join(f"'{p}'" if isinstance(p, str) else p[0] for p in pieces)
        # keys are a hundredth of the texts made of them: files in few parts are dealt out first
        keys = read(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
        return masking.found(keys.select(F.col("c_custkey").alias("doc_id"), F.expr(f"concat({text})").alias("text")))

    return query


def _rules_sql(pieces: list) -> str:
    columns = [f"'{p}'" if isinstance(p, str) else p[0] for p in pieces]
    made = ", ".join(f"{c} as p{k}" for k, c in enumerate(columns))
    at = lambda k: " + ".join(["0", *(f"length(p{j})" for j in range(k))])
    each = [f"""select c_custkey as doc_id, ({at(k)})::bigint as "start", ({at(k + 1)})::bigint as "stop", '{p[1]}' as category, p{k} as value from t""" for k, p in enumerate(pieces) if not isinstance(p, str)]
    return f"with t as (select c_custkey, {made} from customer) {' union all '.join(each)}"


QUERIES = {
    "detect_email": _spans("documents", "doc_id", "text", N.EMAIL_ONCE),
    "detect_phone": _spans("documents", "doc_id", "text", N.PHONE),
    "detect_email_pages": _spans("pages", "page_id", "html", N.EMAIL_ONCE),
    "detect_digit_ids_pages": _spans("pages", "page_id", "html", N.DIGITS, lambda s: N.stands_alone(s) & F.length(s["value"]).isin(*N.DIGIT_IDS)),
    "detect_decimal_money": _spans("documents", "doc_id", "text", N.DECIMAL, lambda s: ~s["before"].rlike("[0-9.,]") & ~s["after"].rlike("[0-9.,]") & s["value"].rlike("[1-9]")),
    "rules_documents": rules_documents,
    "span_union": span_union,
    "span_union_windows": span_union_windows,
    "anonymize_turns": anonymize_turns,
    "label_numbering": label_numbering,
    "label_numbering_conversation": conversation_words,
    "anonymize_documents": anonymize_documents,
    "anonymize_bare": anonymize_bare,
    "restore_roundtrip": restore_roundtrip,
    "restore_nested": restore_nested,
    "circular_labels": circular_labels,
    "leak_scan": leak_scan,
    "unknown_labels": unknown_labels,
    "redaction_targets": redaction_targets,
    "pii_cube": pii_cube,
    "smart_toggle": smart_toggle,
} | {name: _rules(pieces) for name, pieces in RULE_TEXTS.items()}


def _plain(table: str, key: str, text: str, pattern: str, where: str = "true") -> str:
    return f'select {key}, "start", "stop", value from ({matches_sql(table, key, text, pattern)}) where {where}'


_LENGTHS = "length(value) in (" + ", ".join(map(str, N.DIGIT_IDS)) + ")"
ORACLES = {
    "detect_email": _plain("documents", "doc_id", "text", N.EMAIL),
    "detect_phone": _plain("documents", "doc_id", "text", N.PHONE),
    "detect_email_pages": _plain("pages", "page_id", "html", N.EMAIL),
    "detect_digit_ids_pages": _plain("pages", "page_id", "html", N.DIGITS, f"{_ALONE} and {_LENGTHS}"),
    "rules_documents": _rules_documents_sql(),
    "detect_decimal_money": _plain("documents", "doc_id", "text", N.DECIMAL, "not regexp_matches(before, '[0-9.,]') and not regexp_matches(after, '[0-9.,]') and regexp_matches(value, '[1-9]')"),
    "span_union": f'with {_UNITED} select doc_id, "start", "stop", category, value from v',
    "span_union_windows": f'with {_UNITED} select doc_id, "start", "stop", category from u',
    "anonymize_turns": """with t as (select conv_id, turn, coalesce(text, '') as text, conv_id % 3 = 0 as has, 'user' || (turn % 3) || '@example.com' as mail from conversations),
f as (select conv_id, mail, min(turn) as first_turn from t where has group by all),
n as (select conv_id, mail, row_number() over (partition by conv_id order by first_turn) as n from f)
select t.conv_id, t.turn, case when has then text || ' [EMAIL_' || n || ']' else text end as masked from t left join n on t.conv_id = n.conv_id and t.mail = n.mail""",
    "label_numbering": f"with {_UNITED} select distinct doc_id, category, n, '[' || category || '_' || n || ']' as label, value from n",
    "label_numbering_conversation": f"""with s as ({matches_sql('conversations', 'conv_id', 'text', '[A-Z][a-z]{3,}', ', turn')}),
f as (select conv_id, value, min(struct_pack(turn := turn, at := "start")) as first_at from s group by all),
n as (select conv_id, value, row_number() over (partition by conv_id order by first_at) as n from f)
select conv_id, n, '[ФИО_' || n || ']' as label, value from n""",
    "anonymize_documents": f"with {_MASKED} select doc_id, masked, n_spans from a",
    "anonymize_bare": f"with {_BARE} select doc_id, masked from a",
    "restore_roundtrip": f"with {_MASKED} select a.doc_id, a.n_spans as restored, 0 as unresolved, true as equal, sha256(coalesce(d.text, '')) as text_sha256 from a join documents d using (doc_id)",
    "restore_nested": """with d as (select doc_id, coalesce(text, '') as text, doc_id % 40 + 1 as depth, length(coalesce(text, '')) // (doc_id % 40 + 1) as size, case when doc_id % 10 = 3 then doc_id % 7 % (doc_id % 40 + 1) + 1 end as back from documents)
select doc_id, sha256(case when back is null then text else substr(text, 1, (back - 1) * size) || '[ПРОЕКТ_' || back || ']' end) as text_sha256, case when back = 1 then 0 else 1 end::bigint as restored,
  case when back = 1 then 1 else 0 end::bigint as unresolved, case when back is null then 0 else 1 end::bigint as circular from d""",
    "circular_labels": """with recursive e as (select c_custkey % 25 as doc_id, c_custkey as n, case when c_custkey % 11 = 0 then c_custkey - 250 else c_custkey + 25 end as m from customer),
k as (select e.* from e join e f on f.doc_id = e.doc_id and f.n = e.m),
r as (select doc_id, n, m from k union select r.doc_id, r.n, k.m from r join k on k.doc_id = r.doc_id and k.n = r.m)
select distinct doc_id, '[ФИО_' || n || ']' as label from r where n = m""",
    "leak_scan": f"""with {_UNITED}, one as (select doc_id, "start", "stop", '[' || category || '_' || n || ']' as label from n qualify row_number() over (partition by doc_id order by "start") = 1),
o as (select doc_id, substr(text, 1, "start") || label || substr(text, "stop" + 1) as text from documents join one using (doc_id)),
w as (select distinct doc_id, value from n where length(trim(value)) >= 3)
select doc_id, value from w join o using (doc_id) where contains(regexp_replace(text, '[ \\t\\n\u00A0\u202F]+', '', 'g'), regexp_replace(value, '[ \\t\\n\u00A0\u202F]+', '', 'g'))""",
    "unknown_labels": f"with {_UNITED} select doc_id, '[' || category || '_' || (max(n) + 1) || ']' as label from n group by doc_id, category",
    "redaction_targets": f"with {_UNITED}, g as (select doc_id, trim(value) as value, min(\"start\") as first_at from n where length(trim(value)) >= 3 group by all) select doc_id, value, row_number() over (partition by doc_id order by first_at) as place from g",
    "pii_cube": f"with {_RAW} select d.lang, d.source, category, count(*) as n from raw join documents d using (doc_id) group by cube (d.lang, d.source, category)",
    "smart_toggle": """with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k, len(string_split(coalesce(text, ''), chr(10))) as top from documents),
x as (select * from l where k < top or line <> ''),
f as (select *, case when contains(lower(line), 'the ') or contains(lower(line), 'der ') then true when contains(lower(line), 'and ') then false end as flag from x),
m as (select *, coalesce(last_value(flag ignore nulls) over (partition by doc_id order by k rows unbounded preceding), true) as masking from f)
select doc_id, count(*) as lines, count(*) filter (masking) as masked_lines from m group by doc_id""",
} | {name: _rules_sql(pieces) for name, pieces in RULE_TEXTS.items()}
