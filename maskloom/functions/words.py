"""Words behind the checks of rules (roles, institutions, countries, wording of contracts), as patterns of Java."""

from __future__ import annotations

# Dictionary forms of words that name roles and documents, by the kind of contract or body that they belong to.
_ROLES = {
    "sale and supply": "покупатель продавец поставщик товар товары поставка оборудование спецификация",
    "lease": "арендодатель арендатор наймодатель наниматель лизингодатель лизингополучатель лизинг аренда",
    "work and services": "заказчик подрядчик субподрядчик исполнитель застройщик инвестор услуга услуги заказ",
    "carriage and storage": "перевозчик экспедитор отправитель грузоотправитель грузополучатель хранитель поклажедатель фрахтовщик",
    "agency": "агент принципал комитент комиссионер доверитель поверенный представитель посредник брокер оператор",
    "loan and security": "кредитор заёмщик заемщик должник заимодавец займодавец залогодатель залогодержатель поручитель гарант бенефициар цедент цессионарий",
    "gift and trust": "даритель одаряемый учредитель управляющий выгодоприобретатель",
    "insurance and finance": "страховщик страхователь банк вкладчик эмитент акционер плательщик получатель депонент",
    "rights and licences": "лицензиар лицензиат правообладатель пользователь потребитель клиент абонент пациент",
    "labour": "работодатель работник сотрудник",
    "offices": "директор председатель президент руководитель бухгалтер аудитор оценщик заместитель генеральный",
    "persons and bodies": "организация общество компания корпорация предприятие предприниматель учреждение товарищество фирма контрагент сторона участник ответственность юридический физический",
    "documents": "договор контракт соглашение приложение протокол акт устав доверенность положение претензия реквизиты кодекс закон условие обязанность",
}
# Abbreviations of codes of law, as whole words.
_CODES = "гк гпк апк нк ук упк тк ск жк зк коап фз".split()

# Nouns that stand in headings in the genitive plural, which ends like a surname; the other words of headings don't.
# test_rules.KEEP and test_rules.HEADINGS have a heading with each.
_GENITIVES = "расчёт расчет спор платеж срок налог штраф документ рабочих данных персональных"


def _stem(w: str) -> list[str]:
    """What all forms of a word begin with: its dictionary form without the ending."""
    if w.endswith("ец"):
        return [w, w[:-2] + "ц"]  # the vowel is lost in other forms
    if w[-2:] in ("ый", "ий", "ой", "ые", "ие", "ая", "ое"):
        return [w[:-2]]
    return [w.rstrip("ьйаяоеыи") if len(w) > 4 else w]


_NOUN_M = ("", "а", "у", "ом", "е", "ы", "ов", "ам", "ами", "ах")
_NOUN_F = ("а", "ы", "е", "у", "ой", "", "ам", "ами", "ах")
_NOUN_IA = ("я", "и", "ю", "ей", "й", "ям", "ями", "ях")
_NOUN_O = ("о", "а", "у", "ом", "е", "", "ам", "ами", "ах")
_ADJECTIVE = ("ый", "ий", "ой", "ого", "ому", "ым", "им", "ом", "ая", "ую", "ое", "ые", "ых", "ыми", "его", "ему", "ие", "их")
# Bodies of justice and administration by their declension: every form of each, so that surnames that only begin alike are not met.
_BODIES = (
    ("суд трибунал департамент комитет росреестр нотариат", _NOUN_M), ("нотариус", _NOUN_M), ("палат прокуратур служб коллеги", _NOUN_F + _NOUN_IA), ("инспекци администраци", _NOUN_IA),
    ("министерств ведомств агентств казначейств", _NOUN_O), ("управлени отделени", ("е", "я", "ю", "ем", "и", "й", "ям", "ями", "ях")),
    ("арбитражн третейск миров судебн нотариальн районн городск областн краев окружн верховн конституционн апелляционн кассационн федеральн торгово-промышленн таможенн налогов", _ADJECTIVE),
)

# The terms of delivery of Incoterms 2010 and 2020, and codes of currencies of ISO 4217.
INCOTERMS = "exw fca fas fob cfr cif cpt cip dap dpu dat ddp".split()
CURRENCIES = "usd eur rub cny gbp jpy chf kzt byn".split()
# English of contracts that stays readable, by the example in test_rules.KEEP that needs it.
_KEPT_ENGLISH = {
    "обстоятельства (Force Majeure)": "force majeure",
    "This Agreement shall be governed by English law": "this agreement english",
    "The Contract, Annex A and Price List": "the contract annex a price list",
    "на условиях CIF, DAP по Incoterms": "incoterms",
    "в формате PDF по ISO 9001": "pdf iso",
    "SWIFT, BIC, IBAN и VAT указаны ниже": "swift bic iban vat",
}
LATIN_STOP = tuple(sorted({*INCOTERMS, *CURRENCIES, *" ".join(_KEPT_ENGLISH.values()).split()}))
# Marks of legal form that make a company of Latin words.
LATIN_FORMS = tuple("ag ab as bv co corp corporation company gmbh group holding inc incorporated kg limited llc llp lp ltd nv oy plc pte sa sarl se spa srl".split())


def _any(words) -> str:
    """One of the words, longest first."""
    return "(?:" + "|".join(sorted(set(words), key=lambda w: (-len(w), w))) + ")"


_STEMS = [s for words in _ROLES.values() for w in words.split() for s in _stem(w)]
_FORMS_OF_BODIES = [stem + ending for stems, endings in _BODIES for stem in stems.split() for ending in endings]
#: A whole word in any case: a role, code or document; a body; and anything that is no name in capitals.
ROLE_WORD = rf"(?Uiu:(?:{_any(_STEMS)}[а-яё]*|{_any(_CODES)})(?![\w]))"
INSTITUTION_WORD = rf"(?Uiu:{_any(_FORMS_OF_BODIES)}(?![\w]))"
NAMELESS_WORD = rf"(?Uiu:(?:{_any(_STEMS)}[а-яё]*|{_any(_CODES + _FORMS_OF_BODIES)}|{_any(s for w in _GENITIVES.split() for s in (w, w + 'ов', w + 'ей'))})(?![\w]))"
LATIN_WORD = rf"(?i:{_any(LATIN_STOP)}(?![A-Za-z0-9&-]))"
COUNTRY_WORD = r"(?Uiu:(?:рф|росси|федерац)[а-яё]*)"

# Endings of patronymics and of surnames in the cases that stand in headings of contracts.
_PATRONYMICS = "(?:ОВ|ЕВ|Ь)?ИЧ(?:А|У|ЕМ|Е)?|(?:ОВ|ЕВ|ИЧ|ИНИЧ)Н(?:А|Ы|Е|У|ОЙ)"
_SURNAMES = "(?:[ОЕЁ]В|[ИЫ]Н)(?:А|У|ЫМ|ОЙ|ЫХ)?|[СЦ]К(?:ИЙ|ОГО|ОМУ|ИМ|АЯ|ОЙ|УЮ|ИХ)|[ЫИ]Х|ЕНКО|(?:У|Ю|ЧУ)К(?:А|У|ОМ)?|ШВИЛИ|ДЗЕ|ЯН(?:Ц)?(?:А|У)?|ОГЛЫ|КЫЗЫ|ИДИ|АДИ"
#: A word in capitals with the ending of a name, and none of those above.
NAME_WORD = rf"(?U)(?<!\w)(?!{NAMELESS_WORD})[А-ЯЁ]*?(?:{_PATRONYMICS}|{_SURNAMES})(?!\w)"
