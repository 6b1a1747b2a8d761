"""Fixed values of the default factor model.

Results depend on these names and memberships, so they are stated plainly.  Every
function that uses them also accepts other specifications.
"""

MODEL_VERSION = "proxy-thematic-v2"

# Macro factors: kind, long leg, short leg, sign.
MACRO = (
    ("Market", "raw", "IVV", None, 1),
    ("InterestRate", "vol", "TLT", None, -1),
    ("OilPrice", "vol", "USO", None, 1),
    ("GoldPrice", "vol", "GLD", None, 1),
    ("USDollar", "vol", "UUP", "BIL", 1),
    ("CreditRisk", "vol", "JNK", "IEF", 1),
)

# Style factors: long leg, hedge removed by the rolling regression.
STYLE = (
    ("SmallSize", "IJR", "IVV"),
    ("Momentum", "MTUM", "IVV"),
    ("Value", "RPV", "RPG"),
    ("LowVolatility", "SPLV", "SPHB"),
    ("Quality", "SPHQ", "IVV"),
    ("Growth", "IVW", "IVE"),
    ("BetaFactor", "SPHB", "SPLV"),
    ("DividendYield", "VYM", "VUG"),
    ("Liquidity", "OEF", "IWC"),
)

SECTORS = {
    "Sector: Technology": "XLK",
    "Sector: Financials": "XLF",
    "Sector: Health Care": "XLV",
    "Sector: Consumer Discretionary": "XLY",
    "Sector: Consumer Staples": "XLP",
    "Sector: Energy": "XLE",
    "Sector: Materials": "XLB",
    "Sector: Industrials": "XLI",
    "Sector: Utilities": "XLU",
    "Sector: Real Estate": "XLRE",
    "Sector: Communication Services": "XLC",
}

INDUSTRIES = {
    "Industry: Semiconductors": "SOXX",
    "Industry: Software": "IGV",
    "Industry: Biotechnology": "IBB",
    "Industry: Medical Devices": "IHI",
    "Industry: Regional Banks": "KRE",
    "Industry: Aerospace & Defense": "ITA",
    "Industry: Home Construction": "ITB",
    "Industry: Retail": "XRT",
    "Industry: Gold Miners": "GDX",
    "Industry: Clean Energy": "ICLN",
}

COUNTRIES = {
    "Country: Japan": "EWJ",
    "Country: Germany": "EWG",
    "Country: United Kingdom": "EWU",
    "Country: China": "FXI",
    "Country: Brazil": "EWZ",
    "Country: Canada": "EWC",
    "Country: India": "INDA",
    "Country: South Korea": "EWY",
    "Country: Taiwan": "EWT",
    "Country: Australia": "EWA",
}

THEMES = {
    "Theme: AI Capex & Data Centers": ("NVDA", "AMD", "AVGO", "ANET", "VRT", "DELL", "SMCI", "EQIX", "DLR", "MU", "MRVL"),
    "Theme: Space Economy": ("LMT", "NOC", "RTX", "BA", "GD", "LHX", "TDY", "HEI", "IRDM", "VSAT"),
    "Theme: Quantum Computing": ("IBM", "GOOGL", "MSFT", "HON", "INTC", "NVDA", "AMAT", "MU", "ACN"),
    "Theme: Electrification & Power Infrastructure": ("ETN", "PWR", "HUBB", "AME", "GE", "VRT", "EME", "NVT", "PH", "ROK"),
    "Theme: Semiconductor Supply Chain": ("ASML", "AMAT", "LRCX", "KLAC", "TER", "MCHP", "ON", "NXPI", "ADI", "SWKS", "QCOM"),
    "Theme: Cybersecurity": ("PANW", "FTNT", "CHKP", "CRWD", "ZS", "OKTA", "AKAM", "GEN", "TENB", "RPD"),
    "Theme: Robotics & Automation": ("ROK", "AME", "TER", "ISRG", "SYK", "DE", "CAT", "HON", "EMR", "ZBRA"),
    "Theme: Nuclear & Uranium": ("CCJ", "BWXT", "LEU", "UEC", "NXE", "DNN", "UUUU", "EXC", "DUK", "VST"),
    "Theme: Defense & Autonomous Systems": ("LMT", "NOC", "RTX", "GD", "LHX", "AVAV", "KTOS", "LDOS", "HII", "TXT"),
    "Theme: Digital Assets Infrastructure": ("MSTR", "MARA", "RIOT", "CLSK", "HUT", "XYZ", "PYPL", "NVDA", "AMD", "CME"),
}

# Catalog name -> construction name, where the two differ.
CONSTRUCTION_NAMES = {
    "Oil": "OilPrice",
    "Gold": "GoldPrice",
    "Rates": "InterestRate",
    "USD": "USDollar",
    "InformationTechnology": "Sector: Technology",
    "HealthCare": "Sector: Health Care",
    "ConsumerDiscretionary": "Sector: Consumer Discretionary",
    "ConsumerStaples": "Sector: Consumer Staples",
    "CommunicationServices": "Sector: Communication Services",
    "RealEstate": "Sector: Real Estate",
    "Energy": "Sector: Energy",
    "Financials": "Sector: Financials",
    "Industrials": "Sector: Industrials",
    "Materials": "Sector: Materials",
    "Utilities": "Sector: Utilities",
}

CORE_CATALOG = (
    "Market", "Rates", "Oil", "Gold", "USD", "CreditRisk", "SmallSize", "Momentum", "Value",
    "LowVolatility", "Quality", "Growth", "BetaFactor", "DividendYield", "Liquidity",
)
SECTOR_CATALOG = (
    "CommunicationServices", "ConsumerDiscretionary", "ConsumerStaples", "Energy", "Financials",
    "HealthCare", "Industrials", "InformationTechnology", "Materials", "RealEstate", "Utilities",
)
APPROXIMATED_STYLES = ("SmallSize", "Momentum", "LowVolatility", "BetaFactor", "Liquidity")

# Nested catalogs: each level extends the one before it (15, 26, 36, 56 factors).
CATALOGS = {
    "base": CORE_CATALOG,
    "base_sector": CORE_CATALOG + SECTOR_CATALOG,
    "base_sector_industry": CORE_CATALOG + SECTOR_CATALOG + tuple(INDUSTRIES),
    "all_factors": CORE_CATALOG + SECTOR_CATALOG + tuple(INDUSTRIES) + tuple(COUNTRIES) + tuple(THEMES),
}

FAMILY_ORDER = ("market", "macro", "style", "sector", "industry", "country", "thematic")
BENCHMARK = "SPY"
TARGET_VOLATILITY = 0.10


def theme_members(themes=THEMES) -> list[tuple[str, str]]:
    return [(name, ticker) for name, members in themes.items() for ticker in members]


def proxy_tickers() -> list[str]:
    """Sorted symbols the default model needs, the benchmark included."""
    names = {leg for m in MACRO for leg in m[2:4] if leg} | {leg for s in STYLE for leg in s[1:]}
    names |= set(SECTORS.values()) | set(INDUSTRIES.values()) | set(COUNTRIES.values())
    return sorted(names | {t for _, t in theme_members()} | {BENCHMARK})
