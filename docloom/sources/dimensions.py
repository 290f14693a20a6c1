"""Dimension tables. All are small fixed vocabularies, so they are literals of a plan or broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ISO 3166-1 alpha-2, alpha-3, numeric, and the Russian short name.
COUNTRIES = """
AF AFG 4 Афганистан|AL ALB 8 Албания|DZ DZA 12 Алжир|AR ARG 32 Аргентина|AM ARM 51 Армения|AU AUS 36 Австралия
AT AUT 40 Австрия|AZ AZE 31 Азербайджан|BY BLR 112 Беларусь|BE BEL 56 Бельгия|BR BRA 76 Бразилия|BG BGR 100 Болгария
CA CAN 124 Канада|CL CHL 152 Чили|CN CHN 156 Китай|CO COL 170 Колумбия|HR HRV 191 Хорватия|CZ CZE 203 Чехия
DK DNK 208 Дания|EG EGY 818 Египет|EE EST 233 Эстония|FI FIN 246 Финляндия|FR FRA 250 Франция|GE GEO 268 Грузия
DE DEU 276 Германия|GR GRC 300 Греция|HK HKG 344 Гонконг|HU HUN 348 Венгрия|IN IND 356 Индия|ID IDN 360 Индонезия
IR IRN 364 Иран|IQ IRQ 368 Ирак|IE IRL 372 Ирландия|IL ISR 376 Израиль|IT ITA 380 Италия|JP JPN 392 Япония
KZ KAZ 398 Казахстан|KG KGZ 417 Кыргызстан|LV LVA 428 Латвия|LT LTU 440 Литва|LU LUX 442 Люксембург|MY MYS 458 Малайзия
MX MEX 484 Мексика|MD MDA 498 Молдова|NL NLD 528 Нидерланды|NZ NZL 554 Новая Зеландия|NO NOR 578 Норвегия|PK PAK 586 Пакистан
PE PER 604 Перу|PH PHL 608 Филиппины|PL POL 616 Польша|PT PRT 620 Португалия|RO ROU 642 Румыния|RU RUS 643 Россия
SA SAU 682 Саудовская Аравия|RS SRB 688 Сербия|SG SGP 702 Сингапур|SK SVK 703 Словакия|SI SVN 705 Словения|ZA ZAF 710 Южная Африка
KR KOR 410 Южная Корея|ES ESP 724 Испания|SE SWE 752 Швеция|CH CHE 756 Швейцария|TW TWN 158 Тайвань|TJ TJK 762 Таджикистан
TH THA 764 Таиланд|TN TUN 788 Тунис|TR TUR 792 Турция|TM TKM 795 Туркменистан|UA UKR 804 Украина|GB GBR 826 Великобритания
US USA 840 США|UZ UZB 860 Узбекистан|VN VNM 704 Вьетнам
"""

# English names known to the normaliser, with their alpha-3 codes.
ENGLISH = {
    "germany": "DEU", "kyrgyzstan": "KGZ", "kyrgyz republic": "KGZ", "china": "CHN", "russia": "RUS", "turkey": "TUR", "kazakhstan": "KAZ",
    "uzbekistan": "UZB", "sweden": "SWE", "france": "FRA", "italy": "ITA", "usa": "USA", "united states": "USA",
}

# Currency codes in search order with names; symbols; name stems in search order.
CURRENCIES = {
    "EUR": "Euro", "USD": "US Dollar", "CNY": "Chinese Yuan", "RUB": "Russian Ruble", "KGS": "Kyrgyzstani Som", "KZT": "Kazakhstani Tenge",
    "GBP": "British Pound", "CHF": "Swiss Franc",
}
SYMBOLS = {"€": "EUR", "$": "USD", "¥": "CNY", "₽": "RUB", "£": "GBP"}
CURRENCY_STEMS = {
    "euro": "EUR", "евро": "EUR", "us dollar": "USD", "dollar": "USD", "доллар": "USD", "yuan": "CNY", "юань": "CNY", "ruble": "RUB", "рубль": "RUB",
    "som": "KGS", "сом": "KGS", "tenge": "KZT", "тенге": "KZT", "pound": "GBP", "фунт": "GBP", "franc": "CHF", "франк": "CHF",
}

# Fixed values of the scan-table parser: codes and aliases (in search order), currencies, units, markers.
SCAN_COUNTRIES = {
    "CN": "China", "DE": "Germany", "RU": "Russia", "KZ": "Kazakhstan", "KG": "Kyrgyzstan", "AE": "UAE", "US": "USA", "IT": "Italy", "TR": "Turkey",
    "KR": "Korea", "JP": "Japan", "IN": "India", "PL": "Poland", "CZ": "Czech Republic",
}
SCAN_ALIASES = {
    "китай": "CN", "china": "CN", "германия": "DE", "germany": "DE", "россия": "RU", "russia": "RU", "казахстан": "KZ", "kazakhstan": "KZ",
    "кыргызстан": "KG", "kyrgyzstan": "KG", "оаэ": "AE", "uae": "AE", "usa": "US", "сша": "US", "италия": "IT", "italy": "IT", "турция": "TR",
    "turkey": "TR", "корея": "KR", "korea": "KR", "япония": "JP", "japan": "JP", "индия": "IN", "india": "IN",
}
SCAN_CURRENCIES = {
    "USD": "US Dollar", "EUR": "Euro", "RUB": "Russian Ruble", "CNY": "Chinese Yuan", "KZT": "Kazakhstani Tenge", "KGS": "Kyrgyzstani Som",
    "GBP": "British Pound", "AED": "UAE Dirham", "TRY": "Turkish Lira",
}
UNITS = {
    "шт": "шт", "шт.": "шт", "pcs": "pcs", "pc": "pcs", "piece": "pcs", "pieces": "pcs", "kg": "kg", "кг": "кг", "set": "set", "sets": "set",
    "box": "box", "boxes": "box", "уп": "уп", "уп.": "уп", "упак": "упак",
}
TOTAL_MARKERS = ("итого", "subtotal", "grand total", "total amount", "total", "резюме", "summary", "общее число единиц", "total units")
HEADER_MARKERS = ("описан", "description", "код тн", "hs code", "код", "страна происх", "country of origin", "цена", "amount", "quantity", "кол-во", "qty")

# Document codes, labels, result kinds and header fields.
_SIMPLE = "document_number document_date description"
_PERSONS = "document_number authorized_person trusted_person document_date description"
DOCUMENT_TYPES = [
    ("04021", "Invoice", "table", "document_number document_date currency_code currency_name country_sender"),
    ("09022", "Technical Document", "table", "document_date document_number"),
    ("22222", "Protocol testing", "object", ""),
    ("03011", "Contract", "object", "document_number document_date parties subject description"),
    ("00012", "Supply Contract", "object", _SIMPLE),
    ("11019", "Power of Attorney", "object", _PERSONS),
    ("000011", "PA with Trusted Persons Passport", "object", _PERSONS),
    ("00002", "CMR", "object", _SIMPLE),
    ("000004", "Taxpayer Registration Card STI-025", "object", _SIMPLE),
    ("9012", "PASSPORT", "object", _SIMPLE),
    ("01011", "EXPORT/IMPORT License", "object", _SIMPLE),
    ("11111", "Laboratory Test Report", "object", _SIMPLE),
    ("11014", "Veterinary Statement", "object", _SIMPLE),
    ("11116", "Declaration of Conformity", "object", _SIMPLE),
    ("11114", "State Duty Payment Confirmation", "object", _SIMPLE),
    ("010000", "Export Conclusion", "object", _SIMPLE),
    ("01207", "Phytosanitary Certificate", "object", _SIMPLE),
    ("00010", "Ministry of Justice Registration Certificate", "object", _SIMPLE),
    ("01201", "Veterinary Certificate", "object", _SIMPLE),
    ("09999", "Other Documents", "object", _SIMPLE),
    ("10999", "Other Information", "object", _SIMPLE + " hs_code"),
    ("ELSE", "Unknown / Fallback Document", "object", _SIMPLE),
]

# Chunk sizes in characters and worker counts by provider.
PROVIDERS = {"gemini": (100000, 5), "openai": (80000, 5), "ollama": (20000, 5), "cerebras": (3500, 5), "vllm": (20000, 2)}
DEFAULT_CHUNK = (100000, 5)
SUPPORTED = ("gemini", "openai", "cerebras", "ollama", "vllm", "vlm")

ITEM_FIELDS = (
    "description", "quantity", "unit", "cost", "price", "hs_code", "currency_code", "currency_name", "document_date", "document_number",
    "country_origin", "country_origin_code", "country_sender",
)


def country_rows() -> list[tuple[str, str, int, str]]:
    out = []
    for part in COUNTRIES.replace("\n", "|").split("|"):
        if part:
            iso2, alpha3, numeric, name = part.split(" ", 3)
            out.append((iso2, alpha3, int(numeric), name))
    return out


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(country_rows(), "iso2 string, alpha3 string, numeric int, name_ru string")


def document_types(spark: SparkSession) -> DataFrame:
    rows = [(code, label, kind, fields.split()) for code, label, kind, fields in DOCUMENT_TYPES]
    return spark.createDataFrame(rows, "document_code string, label string, result_type string, fields array<string>")


def sql_values(rows: list[tuple], names: str) -> str:
    """A VALUES list as a table expression that both Spark SQL and DuckDB read."""
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS {names}"
