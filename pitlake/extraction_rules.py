"""What to look for in document pages.

All patterns are matched against folded text. NUM and DATE are the number and date shapes of the source documents.
"""

from __future__ import annotations

import re

NUM = r"\d{1,3}(?:\.\d{3})*(?:,\d+)?"
DATE = r"\d{1,2}[./]\d{1,2}[./]\d{4}"
CELL = r"[%\d][\d.,%]*"

# Subscription window: first pattern that hits gives both ends (groups 1 and 2).
WINDOW_PATTERNS = (
    rf"(?:halka\s+arz\s+suresi|talep\s+toplama)[\s\S]{{0,160}}?({DATE})\s*(?:-|ile)\s*({DATE})",
    rf"({DATE})\s*(?:-|ile)\s*({DATE})\s*tarihleri\s+arasinda[\s\S]{{0,80}}?satisa\s+sunulacaktir",
)
# Plain words of which every match holds one, by pattern.
WINDOW_WORDS = (("suresi", "toplama"), ("sunulacaktir",))
# End of the window as later result announcements word it (day, month name, year); never a fact of the offering itself.
RESULT_END_PATTERN = (
    r"(\d{1,2})\s+(ocak|subat|mart|nisan|mayis|haziran|temmuz|agustos|eylul|ekim|kasim|aralik)\s+(\d{4})\s+tarihleri?\s*(?:arasinda|inde)"
    r"[\s\S]{0,120}?talep\s+topla"
)
# How a page ends that may hold the beginning of such a passage: everything of a pattern up to a place where it can be broken, and the page's end.
_DATES_END = rf"(?:\s*\z|\s*(?:-|ile)\s*\z)"
WINDOW_OPENINGS = (
    rf"(?:halka(?:\s*\z|\s+arz(?:\s*\z|\s+suresi))|talep(?:\s*\z|\s+toplama))(?:\z|[\s\S]{{0,160}}?(?:\z|{DATE}{_DATES_END}))",
    rf"{DATE}(?:{_DATES_END}|\s*(?:-|ile)\s*{DATE}(?:\s*\z|\s*tarihleri(?:\s*\z|\s+arasinda[\s\S]{{0,80}}?(?:\z|satisa\s*\z))))",
)
WINDOW_OPENING_WORDS = (("halka", "talep"), (".", "/"))
RESULT_END_OPENING = (
    r"\d{1,2}(?:\s*\z|\s+(?:ocak|subat|mart|nisan|mayis|haziran|temmuz|agustos|eylul|ekim|kasim|aralik)(?:\s*\z|\s+\d{4}(?:\s*\z|\s+tarihleri?"
    r"(?:\s*\z|\s*(?:arasinda|inde)[\s\S]{0,120}?(?:\z|talep\s*\z)))))"
)

# Number fields: (pattern, value group, a plain word every match holds) in priority order.
NUMBER_PATTERNS = {
    "offering_price": (
        (rf"nominal\s+degeri\s+({NUM})\s*tl\s+olup[\s\S]{{0,60}}?({NUM})\s*tl['’]?(?:den|dan|ten|tan)?\s*(?:fiyat(?:tan)?\s+)?satisa\s+sunulacaktir", 2, "olup"),
        (rf"belirlenen\s+({NUM})\s*tl", 1, "belirlenen"),
        (rf"halka\s+arz\s+fiyati\s*\(?\s*tl\s*\)?\s*[:\-]?\s*({NUM})", 1, "fiyati"),
        (rf"halka\s+arz\s+fiyati\s+({NUM})(?!\s*%)", 1, "fiyati"),
    ),
    "capital_increase_shares": (
        (rf"artirilacak\s+({NUM})\s*tl\s+nominal\s+degerli", 1, "artirilacak"),
        (rf"cikarilmasi\s+nedeniyle\s+artirilacak\s+({NUM})\s*tl", 1, "artirilacak"),
    ),
    "total_offered_shares": ((rf"toplam\s+({NUM})\s*tl\)?\s+nominal\s+degerli", 1, "toplam"),),
    "capital_increase_ratio": ((rf"%\s*({NUM})\s+oraninda[^\n]{{0,60}}artir", 1, "oraninda"),),
    "secondary_sale_ratio": ((rf"ortak\s+satisi[^\n]{{0,60}}?%\s*({NUM})", 1, "satisi"),),
    "par_value_per_share": ((rf"(?:bir|beher|her\s+bir)?\s*payin\s+nominal\s+degeri\s+({NUM})\s*tl\s+olu\s*p\b", 1, "payin"),),
    "pre_offer_capital": (
        (rf"sermayesinin\s+({NUM})\s*tl.{{0,3}}den\s+({NUM})\s*tl.{{0,3}}ye\s+cikarilmasi", 1, "sermayesinin"),
        (rf"odenmis\s+sermaye\s+({NUM})\s+({NUM})", 1, "odenmis"),
    ),
    "post_offer_capital": (
        (rf"sermayesinin\s+({NUM})\s*tl.{{0,3}}den\s+({NUM})\s*tl.{{0,3}}ye\s+cikarilmasi", 2, "sermayesinin"),
        (rf"odenmis\s+sermaye\s+({NUM})\s+({NUM})", 2, "odenmis"),
    ),
    "total_participant_count": ((rf"toplam\s+({NUM})\s+yatirimcidan", 1, "yatirimcidan"),),
    "retail_participant_count": (
        (rf"bireysel\s+yatirimcilar\w*\s+{CELL}\s+{CELL}\s+({NUM})\s+{CELL}\s+{CELL}\s+{CELL}\s+({NUM})\s+{CELL}", 1, "bireysel"),
    ),
    "total_demand_multiple": ((rf"({NUM})\s*katina\s+denk\s+gelen", 1, "katina"),),
    "retail_demand_multiple": (
        (rf"bireysel\s+yatirimcilara\s+(?:planlanan\s+)?tahsisat\s+tutarinin\s+(?:yaklasik\s+)?({NUM})\s*kati", 1, "tahsisat"),
    ),
    "retail_allocated_shares": (
        (rf"bireysel\s+yatirimcilar\w*\s+{CELL}\s+{CELL}\s+({NUM})\s+{CELL}\s+{CELL}\s+{CELL}\s+({NUM})\s+{CELL}", 2, "bireysel"),
    ),
    "institutional_allocated_shares": (
        (rf"kurumsal\s+yatirimcilar\w*\s+{CELL}\s+{CELL}\s+({NUM})\s+{CELL}\s+{CELL}\s+{CELL}\s+({NUM})\s+{CELL}", 2, "kurumsal"),
    ),
    "reported_post_money_market_cap": ((rf"nihai\s+deger\s+({NUM})", 1, "nihai"),),
    "reported_pe": ((rf"(?<!ev\s)f\s*/\s*k\s+({NUM})", 1, "/"),),
    "reported_ev_ebitda": ((rf"ev\s*/\s*ebitda\s+({NUM})", 1, "ebitda"),),
    "reported_ps": ((rf"(?:f|pd)\s*/\s*s\s+({NUM})", 1, "/"),),
    "reported_pb": ((rf"pd\s*/\s*dd\s+({NUM})", 1, "dd"),),
    "headline_discount_percentage": ((rf"gore\s+%\s*({NUM})\s*iskontoludur", 1, "iskontoludur"), (rf"iskontosu\s*-?({NUM})%", 1, "iskontosu")),
}
# Restated three-column summary; the last occurrence on a page counts.
VALUATION_TRIPLE = rf"piyasa\s+degeri\s+({NUM})\s+net\s+borc\s+({NUM})\s+firma\s+degeri\s+({NUM})"
VALUATION_TRIPLE_FIELDS = {"reported_post_money_market_cap": 1, "reported_net_debt": 2, "reported_enterprise_value": 3}
# Secondary sale: the one seller inside the share-increase passage.
SELLER_REGION = r"cikarilmasi\s+nedeniyle\s+artirilacak[\s\S]{0,2000}?uzere\s+toplam"
SELLER_ITEM = rf"mevcut\s+ortak\w*[^\n]{{0,200}}?(?:sahip\s+oldugu|ait)\s+({NUM})\s*tl"

DISTRIBUTION_METHODS = (
    "fiyat araligi ile talep toplama", "sabit fiyatla talep toplama", "sabit fiyat ile talep toplama", "degisken fiyatla talep toplama",
    "degisken fiyat ile talep toplama", "borsada satis yontemi", "borsada satis",
)
REGULATION_PATTERN = r"([\w./\-]+)\s+sayili\s+sermaye\s+piyasasi\s+araclarinin\s+satisi\s+tebligi"

ALLOCATION_LINE = (
    rf"({NUM})\s*tl\s+nominal\s+degerdeki\s+kismi\s*\(?\s*({NUM})\s*%\)?\s+([^,.\n]+?)(?:['’](?:a|e|ya|ye|na|ne)|dan|den)?\s*[,.]"
)
# Its first two groups inside a line that matches.
ALLOCATION_AMOUNT, ALLOCATION_SHARE = rf"^({NUM})", rf"kismi\s*\(?\s*({NUM})"
# "<label> dagitim: esit|oransal dagitim yontemine": the cut before the way, and the way itself.
DISTRIBUTION_WAY = r"(?:esit|oransal)\s+dagitim\s+yontemine"
DISTRIBUTION_CUT = r"dagitim\s*:\s*(?=(?:esit|oransal)\s+dagitim\s+yontemine)"
INVESTOR_GROUPS = (
    ("yurt ici bireysel", "retail"), ("bireysel yatirimci", "retail"), ("yuksek talepte bulunacak", "high_demand"),
    ("yurt ici kurumsal", "domestic_institutional"), ("yurt disi kurumsal", "foreign_institutional"),
)
SECTION_HEADINGS = {
    "use_of_proceeds": ("halka arzdan elde edilecek fonun kullanimi", "fon kullanim yeri", "fon kullanimi"),
    "key_risk_items": ("risk faktorleri", "ihracciya iliskin riskler", "halka arz edilecek paylara iliskin riskler"),
}
SECTION_MIN_CHARS = 20

FIELD_NAMES = (
    "subscription_start_date", "subscription_end_date", "offering_price", "currency", "distribution_method", "capital_increase_shares",
    "secondary_sale_shares", "total_offered_shares", "capital_increase_ratio", "secondary_sale_ratio", "par_value_per_share",
    "pre_offer_capital", "post_offer_capital", "investor_group_allocations", "investor_group_distribution_rules",
    "distribution_regulation_reference", "use_of_proceeds", "key_risk_items", "total_participant_count", "retail_participant_count",
    "total_demand_multiple", "retail_demand_multiple", "retail_allocated_shares", "institutional_allocated_shares",
    "reported_post_money_market_cap", "reported_enterprise_value", "reported_net_debt", "reported_pe", "reported_ev_ebitda",
    "reported_ps", "reported_pb", "headline_discount_percentage",
)
# Source order when sources agree, and the fields where the announcement leads.
SOURCE_ORDER = ("approved_prospectus", "investor_sale_announcement", "ipo_results", "price_determination_report")
ANNOUNCEMENT_ORDER = ("investor_sale_announcement", "approved_prospectus", "ipo_results", "price_determination_report")
ANNOUNCEMENT_FIELDS = ("subscription_start_date", "subscription_end_date", "offering_price", "currency", "distribution_method")
PRE_OFFER_SOURCES = ("approved_prospectus", "investor_sale_announcement")

# Financial tables: heading per metric, row labels in order, and the shapes around them.
INCOME_HEADING, BALANCE_HEADING, CASH_HEADING = r"gelir\s+tablosu", r"bilan[c9~]o", r"nakit\s+akis\s+tablosu"
METRIC_HEADINGS = {
    "revenue": INCOME_HEADING, "net_income": INCOME_HEADING, "cash_and_equivalents": BALANCE_HEADING, "financial_debt": BALANCE_HEADING,
    "equity": BALANCE_HEADING, "current_assets": BALANCE_HEADING, "current_liabilities": BALANCE_HEADING,
    "operating_profit": INCOME_HEADING, "operating_cash_flow": CASH_HEADING, "finance_expense": INCOME_HEADING,
}
METRIC_LABELS = {
    "revenue": (r"net\s+satislar", r"\bhasilat\b"),
    "net_income": (r"net\s+kar\b", r"net\s+donem\s+kari", r"\bdonem\s+kar\w*"),
    "cash_and_equivalents": (r"nakit\s+ve\s+(?:nakit\s+)?benzer\w*(?:\s+varl\w*)?",),
    "financial_debt": (r"\bfinansal\s+borc\w*\b",),
    "equity": (r"ana\s+ortak\w*\.?\s+ozkaynak\w*", r"\bozsermaye\b", r"\bozkaynaklar\b"),
    "current_assets": (r"(?:donen|cari)\s+varlik\w*",),
    "current_liabilities": (r"kisa\s+vad\w*\.?\s+yukumluluk\w*",),
    "operating_profit": (r"\bebit\b", r"esas\s+faaliyet\s+kar\w*"),
    "operating_cash_flow": (r"isletme\s+faaliyetlerinden\s+(?:elde\s+edilen\s+)?nakit\w*", r"esas\s+faaliyet\w*"),
    "finance_expense": (r"\bfin\.?\s+gid\w*\b", r"finansman\s+gider\w*"),
}
PERIOD_TOKEN = r"(\d{1,2})\.(\d{1,2})\.(\d{4})|(\d{4})/(\d{1,2})(?!\d)|(?<!\d)(\d{4})(?!\d)(?![a-zA-Z])"
# Two tokens or more, each close to the one before.
_PERIOD = re.sub(r"\((?!\?)", "(?:", PERIOD_TOKEN)
PERIOD_STEP = rf"[\s\S]{{0,35}}?(?:{_PERIOD})"
PERIOD_RUN = rf"(?:{_PERIOD})(?:{PERIOD_STEP})++"
FORECAST_TOKEN = r"(?<!\d)\d{4}t\b"
SIGNED_NUM = r"(?<![a-zA-Z])\(?-?\d{1,3}(?:\.\d{3})*(?:,\d+)?\)?"
# How a row goes on with numbers alone, and a page with a table's rows.
NUMBER_STEP = r"[^\p{L}]{0,35}?" + SIGNED_NUM
TABLE_GAP = 80
TABLE_STEP = rf"[\s\S]{{0,{TABLE_GAP}}}?" + SIGNED_NUM
LABEL_GAP = r"^[\s()./,*\-]*(?:(?:veya|/)\s*zarar\w*[\s()./,*\-]*)?$"
CURRENCY_MARKS = ((r"\bbin\s*tl\b", "thousand"), (r"\bmntl\b", "million"), (r"\btl\b", "unit"))
STANDALONE_MARK, CONSOLIDATED_MARK = r"konsolide\s+olmayan", r"\bkonsolide\b"
HEADER_CHARS, CURRENCY_MARGIN, ROW_CHARS, NEXT_PAGE_CHARS = 300, 80, 400, 1500
