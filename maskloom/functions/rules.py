"""The rule registry: what each rule looks for, which part of it is hidden, and who may object.

Groups that repeat without a bound do so possessively: Java goes one level deeper for each repeat of any other, and a line of some
thousand capitalised words would overflow the stack, which ends the executor.

Patterns are read by Java, with Unicode classes, and applied to one segment at a time. The part named by
``group`` becomes a span unless it is blank or its check rejects or narrows it; triggers stay readable. The order of
the registry is part of the contract, as it decides ties between spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from maskloom.functions import categories as C
from maskloom.functions.words import ROLE_WORD


@dataclass(frozen=True)
class Rule:
    """``place``: where the group lies in the match (all of it, its end, its start, or behind an opening bracket).
    ``check``: a name in ``tagging.CHECKS``. ``needs``: what a text must hold for a match, a cheap gate."""

    name: str
    category: str
    pattern: str
    group: int = 0
    check: str = ""
    needs: str = ""
    place: str = "all"


_UP, _LOW = "[А-ЯЁ]", "[а-яё]"
_TITLE = f"{_UP}{_LOW}+"
_CASES = "(?:а|у|ым|ом|е|ой|ою|ого|ому|их|ыми?|им)?"
_SURNAME = f"{_UP}{_LOW}*(?:[оеё]в|[иы]н|ск|цк)(?:{_CASES}|ий|ая|ую)(?:-{_TITLE})?|{_UP}{_LOW}+(?:енко|швили|дзе|ян|ук|юк)"
_SURNAME = f"(?:{_SURNAME})"
_PATRONYMIC = f"{_UP}{_LOW}+(?:[ое]вич(?:а|у|ем|е)?|ич(?:а|у|ем|е)?|(?:[ое]в|ич|инич)н(?:а|ы|е|у|ой))"
_INITIALS = rf"{_UP}\.\s?{_UP}\."
_CADASTRE = r"\d{2}:\d{2}:\d{6,7}:\d{1,5}"
_AUTHORITY = r"(?:[А-ЯЁ]{2,}|ТП|[Оо]тдел\w*|[Уу]правлени\w*|[Мм]илици\w*|[Пп]олици\w*|[Пп]аспортн\w+|[Гг]лавн\w+|[Мм]играционн\w+)\b"
_DATE = r"[0-3]?\d\.[01]?\d\.(?:19|20)\d\d"
_QUOTED = r"(?:«[^»\n]{1,120}»|\"[^\"\n]{1,120}\"|“[^”\n]{1,120}”|„[^“”\n]{1,120}[“”])"
_FORMS = (
    "ООО|ОАО|ЗАО|ПАО|АО|НАО|ИП|НКО|АНО|НП|ПК|КФХ|СНТ|ГУП|МУП|ФГУП|ФГБУ|ГБУ|МБУ|ТОО|ТСЖ|[Фф]онд\\w*|[Бб]анк\\w*|[Кк]ооператив\\w*|[Оо]бществ\\w+ с ограниченной ответственностью|[Аа]кционерн\\w+ обществ\\w+"
)
_NUMBER = r"(?>\d{1,3}(?:[   .]\d{3}){1,6}|\d{1,15})(?:[.,]\d{1,2})?"
_WORDS = r"(?:\s?\([^()\n]{1,200}\))?"
_CURRENCY = r"(?:руб(?:л(?:ей|я|ь|ями?|ях))?\b\.?|₽|коп(?:е(?:ек|йки|йка))?\b\.?|долл(?:ар\w*|\b\.?)|у\.\s?е\.|евро\b|юан\w*|USD\b|EUR\b|RUB\b|CNY\b)"
_NUMERAL = (
    "один|одна|одно|два|две|три|четыре|пять|шесть|семь|восемь|девять|десять|\\w+надцать|двадцать|тридцать|сорок|\\w+десят|девяносто|сто|двести|"
    "триста|четыреста|\\w+сот|тысяч\\w*|миллион\\w*|миллиард\\w*"
)
_ABBREVIATION = "(?<!\\bг)(?<!\\bул)(?<!\\bд)(?<!\\bстр)(?<!\\bкорп)(?<!\\bкв)(?<!\\bпом)(?<!\\bоф)(?<!\\bобл)(?<!\\bпос)(?<!\\bпер)(?<!\\bпл)(?<!\\bнаб)(?<!\\bпр)(?<!\\bш)(?<!\\bим)(?<!\\b[А-ЯЁA-Z])"
_STOP = rf"{_ABBREVIATION}\.(?=\s+[А-ЯЁA-Z\[]|\s*$)"
_REST = rf"(?:(?!{_STOP})[^\n])"
_STREET = "(?:ул|улица|пр|пр-т|проспект|пер|переулок|пл|площадь|наб|набережная|ш|шоссе|бульв|бульвар|б-р|проезд|тупик|аллея|мкр|микрорайон)"
_BUILDING = r"(?:д|дом|корп|корпус|к|стр|строение|кв|квартира|оф|офис|пом|помещение|лит|литера)"
_LATIN = r"[A-Z][A-Za-z0-9&-]*(?![\w@])"
_PART, _TOP = r"\s?\.\s?[\w-]+", r"\.\s?[A-Za-zА-Яа-яЁё]{2,}"
_PARTS = rf"(?:(?!{_TOP}){_PART})*+"  # of a domain, none of which can be its last
_BETWEEN = r"\b[^\d\n]{0,40}?"  # words between what a number is and the number
_BARE = r"(?<![\w-])(?<!\d[.,])"
_END = r"(?![\w-])(?![.,]\d)"


def _rule(name: str, category: str, pattern: str, group: int = 0, check: str = "", any_case: bool = False, needs: str = "я", place: str = "", first: str = "") -> Rule:
    """``first``: what a match begins with, as a class; looked at before the costlier search for the edge of a word."""
    return Rule(name, category, ("(?Uiu)" if any_case else "(?U)") + (f"(?=[{first}])" if first else "") + pattern, group, check, needs, place or ("end" if group else "all"))


def _bare(name: str, category: str, digits: int) -> Rule:
    return _rule(name, category, rf"{_BARE}\d{{{digits}}}{_END}", needs="0", first=r"\d")


RULES: tuple[Rule, ...] = (
    _rule("project", C.PROJECT, rf"\b(?:проект|объект|программ|инициатив)\w*\s+({_QUOTED})", 1, first="пои"),
    _rule("org_form", C.ORG, rf"\b(?:{_FORMS})\s*({_QUOTED})", 1, first="А-ЯЁфбкоа"),
    _rule("sole_trader_initials", C.PERSON, rf"\b(?:ИП|[Ии]ндивидуальн\w+ предпринимател\w+)\s+{_TITLE}\s+{_INITIALS}", first="Ии"),
    _rule("sole_trader_full", C.PERSON, rf"\b(?:ИП|[Ии]ндивидуальн\w+ предпринимател\w+)\s+{_TITLE}\s+{_TITLE}\s+{_TITLE}", first="Ии"),
    _rule("surname_given_patronymic", C.PERSON, rf"\b{_SURNAME}\s+{_TITLE}\s+{_PATRONYMIC}\b", first="А-ЯЁ"),
    _rule("given_patronymic_surname", C.PERSON, rf"\b{_TITLE}\s+{_PATRONYMIC}\s+{_SURNAME}\b", first="А-ЯЁ"),
    _rule("surname_initials", C.PERSON, rf"\b{_SURNAME}\s+{_INITIALS}", first="А-ЯЁ"),
    _rule("initials_surname", C.PERSON, rf"\b{_INITIALS}\s?{_SURNAME}\b", first="А-ЯЁ"),
    _rule("register_number", C.EGRN, rf"(?<!\d)(?:{_CADASTRE}\s*[-–—]\s*\d{{2}}/\d{{3}}/\d{{4}}-\d+|\d{{2}}-\d{{2}}/\d{{3,4}}-\d+)", needs="0", first=r"\d"),
    _rule("cadastre", C.CADASTRE, rf"(?<!\d){_CADASTRE}(?!\d)", needs="0", first=r"\d"),
    _rule("passport_issued", C.PASSPORT_ISSUED, rf"\b[Вв]ыдан\w*:?\s+({_AUTHORITY}[^\n]{{3,200}}?)(?=,?\s*(?:{_DATE}|код\b|\d{{3}}-\d{{3}})|[;\n]|$)", 1, first="Вв"),
    _rule("passport_series", C.PASSPORT, r"\bсери[яи]\s*:?\s*(\d{2}\s?\d{2}\s*(?:№|номер|N)?\s*\d{6})", 1, any_case=True, needs="я0", first="с"),
    _rule("passport", C.PASSPORT, r"\bпаспорт\w*(?:\s+(?:РФ|гражданина РФ))?\s*:?\s*(?:№\s*)?(\d{2}\s?\d{2}\s*(?:№\s*)?\d{6})(?!\d)", 1, any_case=True, needs="я0", first="п"),
    _rule("snils", C.SNILS, r"\b(?:снилс|страхово\w+ (?:свидетельств\w+|номер\w*))\s*:?\s*(?:№\s*)?(\d{3}-\d{3}-\d{3}[ -]\d{2}|\d{11})(?!\d)", 1, any_case=True, needs="я0", first="с"),
    _rule("division_code", C.DIV_CODE, r"\bкод\s+подразделения\s*:?\s*(\d{3}[-–]?\d{3})(?!\d)", 1, any_case=True, needs="я0", first="к"),
    _rule("born", C.BIRTH_DATE, rf"({_DATE})\s*(?:(?:г\.?\s*|года?\s+)?рождения|г\.\s?р\b)", 1, needs="я0", place="start"),
    _rule("birth_date", C.BIRTH_DATE, rf"\bдат[аы]\s+рождения\s*:?\s*({_DATE})", 1, any_case=True, needs="я0", first="д"),
    _rule("issue_date", C.ISSUE_DATE, rf"\bдат[аы]\s+выдачи\s*:?\s*({_DATE})", 1, any_case=True, needs="я0", first="д"),
    _rule("birth_place", C.BIRTH_PLACE, r"\b[Мм]есто\s+рождения\s*:\s*([^\n]{3,200}?)(?=[,;.]?\s*(?:[Пп]аспорт|[Сс]ерия)|[;\n]|$)", 1, first="Мм"),
    _rule("registered_at", C.ADDRESS, rf"\b[Зз]арегистрирован\w*\s+по\s+адресу\s*:?\s*({_REST}{{5,250}}?)(?=\s*(?:[Пп]аспорт|ИНН|СНИЛС|[Тт]ел\b)|{_STOP}|\n|$)", 1, first="Зз"),
    _rule("registration_address", C.ADDRESS, rf"\b[Аа]дрес\s+регистрации\s*:\s*({_REST}{{5,250}}?)(?=\s*(?:[Пп]аспорт|ИНН|СНИЛС|[Тт]ел\b)|{_STOP}|\n|$)", 1, first="Аа"),
    _rule("labelled_address", C.ADDRESS, rf"\b(?:[Юю]ридический|[Пп]очтовый|[Фф]актический|[Мм]есто нахождения|[Аа]дрес)(?:\s+адрес)?\s*:\s*({_REST}{{10,200}}?)(?={_STOP}|\s*;|\n|$)", 1, first="ЮюПпФфМмАа"),
    _rule("street_address", C.ADDRESS, rf"(?:\bг\.\s?|\bгород\s+){_TITLE}(?:-{_TITLE})?,\s*{_STREET}\.?\s+[^\n,]{{2,60}}(?:,\s*{_BUILDING}\.?\s*\d+[\w/-]*)+", needs="я0", first="г"),
    _rule("building_part", C.ADDRESS, rf"\b(?:д|дом|корп|корпус|строение|кв|квартира|оф|офис|пом|помещение|этаж|подъезд|комната|секция)\b\.?\s*(?:№\s*)?(\d+[а-я]?(?:/\d+)?|(?-i:[IVXLC]+))\b", 1, any_case=True, first="дксопэ"),
    _rule("account", C.ACCOUNT, r"(?:р/с|к/с|р/сч|корр?\.?\s*сч[её]т|расч[её]тный\s+сч[её]т|сч[её]т)\w*\s*:?\s*(?:№\s*)?(\d{20})(?!\d)", 1, any_case=True, needs="я0", first="ркс"),
    _bare("bare_account", C.ACCOUNT, 20),
    _rule("ogrn", C.OGRN, r"\bОГРН(?:ИП)?\s*:?\s*(?:№\s*)?(\d{13,15})(?!\d)", 1, any_case=True, needs="я0", first="о"),
    _bare("bare_ogrnip", C.OGRN, 15),
    _bare("bare_ogrn", C.OGRN, 13),
    _rule("inn_person", C.INN_PERSON, rf"\bИНН{_BETWEEN}(\d{{12}})(?!\d)", 1, any_case=True, needs="я0", first="и"),
    _bare("bare_inn_person", C.INN_PERSON, 12),
    _rule("inn_company", C.INN_COMPANY, rf"\bИНН{_BETWEEN}(\d{{10}})(?!\d)", 1, any_case=True, needs="я0", first="и"),
    _bare("bare_inn_company", C.INN_COMPANY, 10),
    _rule("kpp", C.KPP, r"\bКПП\s*:?\s*(?:№\s*)?(\d{9})(?!\d)", 1, any_case=True, needs="я0", first="к"),
    _rule("bik", C.BIK, rf"\bБИК{_BETWEEN}(\d{{9}})(?!\d)", 1, any_case=True, needs="я0", first="б"),
    _rule("bare_bik", C.BIK, rf"{_BARE}04\d{{7}}{_END}", needs="0", first="0"),
    _rule("swift", C.SWIFT, r"\b(?:SWIFT|СВИФТ)(?:-код|\s+code|\s+код)?\s*:?\s*([A-Z]{6}[A-Z0-9]{2,5})\b", 1, needs="", first="SС"),
    _rule("caps_name", C.PERSON, rf"(?<![\w-]){_UP}{{2,}}(?:-{_UP}{{2,}})?(?:\s+{_UP}{{2,}}(?:-{_UP}{{2,}})?){{1,2}}(?![\w-])", 0, "caps_name", first="А-ЯЁ"),
    _rule("caps_surname_initials", C.PERSON, rf"(?<!\w){_UP}{{3,}}(?:-{_UP}{{2,}})?\s+{_INITIALS}", first="А-ЯЁ"),
    _rule("initials_caps_surname", C.PERSON, rf"(?<!\w){_INITIALS}\s?{_UP}{{3,}}(?:-{_UP}{{2,}})?(?!\w)", first="А-ЯЁ"),
    _rule("email", C.EMAIL, rf"[\w.+-]+\s?@\s?[\w-]+(?:{_PARTS}(?={_TOP}){_PART}(?={_PARTS}{_TOP}))*+{_PARTS}{_TOP}", needs="@"),
    _rule("phone_brackets", C.PHONE, r"\(\d{3,5}\)[\s-]?\d{1,3}[\s-]?\d{2}[\s-]?\d{2}(?!\d)", needs="0"),
    _rule("phone_short", C.PHONE, r"(?<![\d-])\d{3}-\d{2}-\d{2}(?![\d-])", needs="0", first=r"\d"),
    _rule("phone", C.PHONE, r"(?<![\w+])(?:\+7|7|8)[\s-]?(?:\(?\d{3}\)?(?:[\s-]?\d){7}|\(\d{4}\)(?:[\s-]?\d){6}|\(\d{5}\)(?:[\s-]?\d){5})(?!\d)", needs="0", first="+78"),
    _rule("document_number", C.DOC_NO, r"(№\s*)((?=[\w/.\-]*\d)[A-Za-zА-Яа-яЁё0-9][\w/.\-]*[\w]|\d)", 2, "document_number", needs="№0"),
    _rule("money", C.MONEY, rf"(?<![\w.,])({_NUMBER}{_WORDS})\s*{_CURRENCY}", 1, "not_zero", True, needs="0", place="start", first=r"\d"),
    _rule("money_sign", C.MONEY, rf"([$€₽£¥]|\b(?:USD|EUR|RUB|CNY)\b)\s?({_NUMBER})", 2, "not_zero", needs="0"),
    _rule("money_words", C.MONEY, rf"\(\s*((?:{_NUMERAL})(?:\s+(?!{_CURRENCY})(?:{_NUMERAL})(?=[\s)]))*+(?:\s+{_CURRENCY}[^()\n]{{0,80}}?)?)\s*\)(?!\s*(?:календарн|рабоч|банковск|дн))", 1, "", True, place="inside"),
    _rule("money_grouped", C.MONEY, r"(?<![\d.,])\d{1,3}(?:[   ]\d{3})+(?:[.,]\d{1,2})?(?![\d])", 0, "not_zero", needs="0", first=r"\d"),
    _rule("money_decimal", C.MONEY, r"(?<![\d.,])\d+[.,]\d{2}(?![.,]?\d)(?!\.\d)", 0, "plain_money", needs="0", first=r"\d"),
    _bare("bare_number_11", C.DOC_NO, 11),
    _bare("bare_number_14", C.DOC_NO, 14),
    _bare("postal_index", C.INDEX, 6),
    _rule("latin_org", C.ORG, rf"(?<![\w@.-]){_LATIN}(?:\s+(?:&\s+)?{_LATIN})*+", 0, "latin_org", needs="", first="A-Z"),
)
DATES = _rule("date", C.DATE, r"(?<!\d)(?:[0-3]?\d[./-][01]?\d[./-](?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d[./-][01]?\d[./-][0-3]?\d)(?!\d)", needs="0")
ORDER = {r.name: k for k, r in enumerate((*RULES, DATES))}

#: A small recogniser of people and places by endings and triggers; a role before a name stays outside unless it is a surname.
PEOPLE = rf"(?U)\b(?={_UP})(?:(?={_SURNAME}\s)|(?!{ROLE_WORD}))(?:{_SURNAME}\s+{_TITLE}(?:\s+{_PATRONYMIC})?|{_TITLE}\s+{_SURNAME})\b"
PLACES = rf"(?U)(?:\bг\.\s?|\bгород(?:а|е|у)?\s+|\bсел[оае]\s+|\bпос\.\s?)({_TITLE}(?:-{_TITLE})?)"

#: What a rule cannot match without. Letters of the first range include those that equal Cyrillic ones in another case.
MARKS = {"я": "[\u0400-\u04FF\u1C80-\u1C88]", "0": r"(?U)\d", "@": "@", "№": "№"}
