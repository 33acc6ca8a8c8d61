"""Document classes, keyword lists and sector tables, stated as the domain defines them."""

from __future__ import annotations

# Title substrings in priority order; the first hit decides.
TITLE_RULES = (
    ("onayli izahname", "approved_prospectus"),
    ("izahname", "approved_prospectus"),
    ("tasarruf sahiplerine satis duyurusu", "investor_sale_announcement"),
    ("fiyat tespit raporuna iliskin analist raporu", "price_determination_review"),
    ("fiyat tespit raporuna iliskin degerlendirme raporu", "price_determination_review"),
    ("fiyat tespit raporu", "price_determination_report"),
    ("halka arz sonuclari", "ipo_results"),
    ("islem gormeye baslama", "trading_start"),
)
REVIEW_MARKERS = ("analist", "degerlendirme")
TARGET_TYPES = ("approved_prospectus", "investor_sale_announcement", "price_determination_report", "ipo_results", "trading_start")

# Further classes for link texts that no title rule names (regular expressions).
LINK_RULES = (
    (r"fon\w*\s+kullan", "use_of_proceeds_report"),
    (r"finansal tablolar", "financial_statement_attachment"),
    (r"bagimsiz denetim raporu", "financial_statement_attachment"),
)
LINK_TYPES = ("approved_prospectus", "investor_sale_announcement", "price_determination_report",
              "financial_statement_attachment", "use_of_proceeds_report")

PROSPECTUS_STEM = "izahname"
APPENDIX_PATTERN = r"\bek[\s_.\-]*\d|\bekleri\b|\beki\b"
APPENDIX_KEYWORDS = (
    "esas sozlesme", "ic yonerge", "denetim rapor", "denetim kurulu", "hukukcu rapor", "degerleme rapor", "degerleme kurulu",
    "sorumluluk beyan", "fiyat tespit rapor", "fon kullanim", "kullanim yeri", "yonetim kurulu", "ttsg", "katilim finans", "gayrimenkul",
)
ATTACHMENT_RULES = (
    ("imza", "signature"), ("kapak", "cover_page"), ("analist", "analyst_review"), ("degerlendirme", "analyst_review"),
    ("esas sozlesme", "appendix"), ("denetim raporu", "appendix"),
)
WITHDRAWAL_WORDS = ("iptal", "vazgecme", "vazgecti", "erteleme", "durduruldu", "askiya alin")

# Company-name patterns in priority order.
SECTOR_RULES = (
    (r"\bsigorta\b|hayat ve emeklilik|\bemeklilik\b", "insurance"),
    (r"\bbankasi\b|\bbank\b", "banking"),
    (r"gayrimenkul yatirim ortakligi|\bgyo\b", "reit"),
    (r"yatirim ortakligi", "investment_holding"),
)
SECTOR_SKIPS_METRIC = {"insurance": ("revenue", "operating_profit"), "banking": ("current_assets", "current_liabilities")}
SECTOR_SKIPS_RATIO = {"insurance": ("revenue_growth_yoy", "net_margin", "interest_coverage"), "banking": ("current_ratio",)}
SECTOR_SKIPS_MULTIPLE = {"insurance": ("ps_at_offer",)}

# Budgets of sections in characters, and the keyword families of each section category, in order.
TOTAL_CHARS = 12_000
SECTION_CHARS = 1_500
CATEGORY_KEYWORDS = (
    ("offering_structure", ("halka arz", "talep toplama", "dagitim yontemi", "sermaye artirimi", "ortak satisi")),
    ("use_of_proceeds", ("fon kullanim",)),
    ("risk_factors", ("risk faktorleri", "riskler")),
    ("financial_position", ("finansal durum", "mali durum", "bilanco", "finansal tablolar")),
    ("indebtedness", ("borclanma", "finansal borclar", "yukumlulukler")),
    ("related_party_transactions", ("iliskili taraf",)),
    ("litigation", ("dava", "hukuki takip", "ihtilaf")),
    ("dividend_policy", ("kar payi dagitim", "temettu")),
)
