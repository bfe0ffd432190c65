"""Categories of sensitive spans: their tags, and the priorities that decide overlaps."""

from __future__ import annotations

# Tags as they stand in labels, and priorities. Labels of stored texts depend on both.
PERSON, ORG, PROJECT, ADDRESS = "ФИО", "ОРГАНИЗАЦИЯ", "ПРОЕКТ", "АДРЕС"
EMAIL, PHONE, MONEY, ACCOUNT = "EMAIL", "ТЕЛЕФОН", "СУММА", "СЧЁТ"
INN_COMPANY, INN_PERSON, OGRN, KPP = "ИНН_ЮЛ", "ИНН_ФЛ", "ОГРН", "КПП"
INDEX, DOC_NO, BIK, SWIFT = "ИНДЕКС", "НОМЕР", "БИК", "SWIFT"
PASSPORT, PASSPORT_ISSUED, DIV_CODE, SNILS = "ПАСПОРТ", "ВЫДАН", "КОД_ПОДР", "СНИЛС"
BIRTH_DATE, BIRTH_PLACE, ISSUE_DATE = "ДР", "МЕСТО_РОЖДЕНИЯ", "ДАТА_ВЫДАЧИ"
CADASTRE, EGRN, DATE = "КАДАСТР", "ЕГРН", "ДАТА"

PRIORITY = {
    PERSON: 100,
    PASSPORT: 95, SNILS: 95, INN_PERSON: 95,
    BIRTH_DATE: 92, BIRTH_PLACE: 92, PASSPORT_ISSUED: 92, DIV_CODE: 92,
    ISSUE_DATE: 90, ORG: 80, PROJECT: 78, EMAIL: 75, PHONE: 75, ADDRESS: 70,
    ACCOUNT: 65, INN_COMPANY: 65, OGRN: 65, KPP: 65, BIK: 65, SWIFT: 65, CADASTRE: 65, EGRN: 65,
    MONEY: 40, DOC_NO: 30, INDEX: 20, DATE: 10,
}

#: Phrases that switch masking off and on again between the sections of a contract.
SECTION_OFF = ("предмет договор",)
SECTION_ON = ("адреса и реквизиты", "реквизиты сторон", "подписи сторон", "адреса, реквизиты", "реквизиты банка")

#: Changes whenever rules, word lists or numbering change: labels of earlier texts would else point elsewhere.
RULES_VERSION = "3"
