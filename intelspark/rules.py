"""Fixed values of the rule book.

Everything in this file is data: word lists, thresholds, labels, texts and catalogs that the
results depend on. Operators take these as default arguments, so a user can pass their own.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values: landing

DATE_KEYS = (
    "end_of_day", "end_of_month", "date", "release_date",
    "release_datetime", "publish_date", "effective_date", "time_period",
)
MISSING_TOKENS = ("", "-", "--", "na", "n/a", "null", "none")
NATURAL_KEY_FIELDS = (
    "id", "uuid", "ref_no", "reference_no", "reference_number", "end_of_day",
    "end_of_month", "release_date", "title", "subject", "time_period",
)
NON_METRIC_FIELDS = ("end_of_day", "end_of_month", "date", "release_date")

# ---------------------------------------------------------------- fixed values: classification

SIGNAL_TYPE_GROUPS = (
    ("cross_border", ("export", "trade", "cross", "fx", "cny", "usd")),
    ("risk", ("unemployment", "risk", "loan", "impairment")),
    ("growth", ("growth", "gdp", "output", "expansion", "industry", "agriculture")),
    ("financing", ("fund", "finance", "liquidity", "consumption")),
)
NEWS_TYPE_GROUPS = (
    ("cross_border", ("cross-border", "cross border", "overseas", "mainland", "gba")),
    ("financing", ("fund", "financing", "capital", "fundraising", "ipo")),
    ("risk", ("risk", "warning", "volatility", "uncertainty")),
    ("growth", ("expansion", "growth", "investment", "launch")),
)
ANNOUNCEMENT_TYPE_GROUPS = (
    ("financing", ("ipo", "上市", "招股", "首发")),
    ("risk", ("风险", "处罚", "诉讼", "减值", "亏损", "st")),
    ("growth", ("并购", "收购", "扩产", "投资", "增长", "合作")),
)
POLICY_CROSS_BORDER_TOKENS = (
    "greater bay area", "cross-boundary", "cross border", "guangdong", "shenzhen", "guangzhou",
    "粤港澳大湾区", "跨境", "广东", "深圳", "广州",
)
POLICY_TYPE_GROUPS = (
    ("financing", ("fund", "financing", "capital", "investment", "finance", "贷款", "融资", "投资", "金融")),
    ("risk", ("risk", "warning", "fraud", "penalty", "uncertainty", "风险", "警告", "处罚")),
    ("growth", ("innovation", "technology", "manufacturing", "startup", "growth", "创新", "科技", "制造", "增长")),
)
GBA_KEYWORDS = {
    "en": (
        "greater bay area", "guangdong", "shenzhen", "guangzhou", "enterprise", "company", "industry",
        "manufacturing", "innovation", "technology", "cross-boundary",
    ),
    "tc": ("粤港澳大湾区", "大湾区", "广东", "深圳", "广州", "企业", "公司", "产业", "制造", "创新", "科技", "跨境"),
}
GBA_GEO_KEYWORDS = {
    "en": ("greater bay area", "guangdong", "shenzhen", "guangzhou", "hong kong", "macao"),
    "tc": ("粤港澳大湾区", "大湾区", "广东", "深圳", "广州", "香港", "澳门"),
}
GBA_BUSINESS_KEYWORDS = {
    "en": (
        "enterprise", "company", "industry", "manufacturing", "innovation", "technology", "trade",
        "investment", "finance", "business",
    ),
    "tc": ("企业", "公司", "产业", "制造", "创新", "科技", "贸易", "投资", "金融", "商业"),
}
AGGREGATE_PROFILE_TERMS = ("portfolio", "intelligence profile", "cluster", "sector", "national accounts")
INDICATOR_LABELS = {
    "neeri_2020_trade_wgt": "NEERI trade-weighted index",
    "neeri_2020_import_wgt": "NEERI import-weighted index",
    "neeri_2020_export_wgt": "NEERI export-weighted index",
    "zar": "South African rand FX reference",
    "idr": "Indonesian rupiah FX reference",
    "inr": "Indian rupee FX reference",
    "usd": "US dollar FX reference",
    "eur": "Euro FX reference",
    "cny": "Renminbi FX reference",
    "jpy": "Japanese yen FX reference",
    "gbp": "British pound FX reference",
    "aud": "Australian dollar FX reference",
    "cad": "Canadian dollar FX reference",
    "sgd": "Singapore dollar FX reference",
}

# ---------------------------------------------------------------- fixed values: signal classes

OPPORTUNITY_TYPES = ("growth", "cross_border", "market", "financing", "expansion", "acquisition", "m&a", "trade")
RISK_TYPES = ("risk", "regulatory", "compliance", "warning", "litigation")
CONTEXT_TYPES = ("market", "cross_border", "trade", "policy", "macro", "financing")
CROSS_BORDER_TYPES = ("cross_border", "trade")
FINANCING_ROLLUP_TYPES = ("financing", "funding", "market", "growth", "expansion")
GROWTH_LIKE_TYPES = ("growth", "expansion", "acquisition", "m&a", "management_discussion")
HIT_STATUSES = ("used", "success", "completed", "hit")

# ---------------------------------------------------------------- fixed values: linkage

LINKAGE_TAXONOMY = (
    # type, label, default strength, supports company scoring, context only
    ("direct_company_link", "Direct company link", "strong", True, False),
    ("industry_link", "Industry link", "medium", True, False),
    ("region_link", "Region link", "medium", True, False),
    ("cross_border_exposure_link", "Cross-border exposure link", "medium", True, False),
    ("macro_context_link", "Macro context link", "weak", False, True),
)
LINKAGE_RATIONALE = {
    "direct_company_link": "Signal is directly mapped to the company.",
    "macro_context_link": "Signal provides market background but is not company-specific.",
    "cross_border_exposure_link": "Signal matches the company's regional or cross-border operating context.",
    "region_link": "Signal matches the company's regional market context.",
    "industry_link": "Signal is treated as linked sector context.",
}

# ---------------------------------------------------------------- fixed values: scorecard

Q_PRIORITY = "Is this company worth prioritizing now?"
Q_WHY_NOW = "Why now?"
Q_ENTRY = "What is the best business entry angle?"
Q_RISK = "What risks or uncertainties should be surfaced before action?"
Q_CONFIDENCE = "How reliable is the current view?"
FEATURES = (
    # key, label, group, business question, cap
    ("growth_activity_intensity", "Growth activity intensity", "commercial_attractiveness", Q_PRIORITY, 24),
    ("market_visibility", "Market visibility", "commercial_attractiveness", Q_PRIORITY, 12),
    ("business_event_specificity", "Business event specificity", "commercial_attractiveness", Q_PRIORITY, 10),
    ("recent_activity_momentum", "Recent activity momentum", "immediacy", Q_WHY_NOW, 12),
    ("management_update_availability", "Management update availability", "immediacy", Q_WHY_NOW, 10),
    ("top_product_fit_strength", "Top product fit strength", "product_fit", Q_ENTRY, 15),
    ("cross_border_operating_exposure", "Cross-border operating exposure", "product_fit", Q_ENTRY, 18),
    ("linked_risk_severity", "Linked risk severity", "risk_penalty", Q_RISK, 35),
    ("structured_risk_coverage", "Structured risk coverage", "risk_penalty", Q_RISK, 10),
    ("direct_evidence_ratio", "Direct evidence ratio", "evidence_confidence", Q_CONFIDENCE, 30),
    ("structured_evidence_coverage", "Structured evidence coverage", "evidence_confidence", Q_CONFIDENCE, 25),
    ("source_diversity", "Source diversity", "evidence_confidence", Q_CONFIDENCE, 15),
)
FEATURE_CAPS = {key: cap for key, _, _, _, cap in FEATURES}
GROUP_CAPS = {
    "commercial_attractiveness": 40,
    "immediacy": 25,
    "product_fit": 35,
    "risk_penalty": 100,
    "evidence_confidence": 100,
}
SEVERITY_PENALTY = {"high": 35, "medium": 20, "low": 10}
SEVERITY_PENALTY_OTHER = 15
PRIORITY_POLICY = {
    "opportunity_weight": 0.60,
    "evidence_confidence_weight": 0.15,
    "risk_buffer_weight": 0.25,
    "risk_headroom_cap": 40,
    "high_priority_threshold": 50,
    "medium_priority_threshold": 38,
}
SCORECARD_VERSION = "prospect-scorecard-v0.2"
PRODUCTS = (
    # name, fit score, triggering signal types, triggering linkage types, needs a risk item
    ("cross-border payments", 88, ("cross_border", "trade"), ("cross_border_exposure_link",), False),
    ("trade finance", 80, ("cross_border", "trade"), ("cross_border_exposure_link",), False),
    ("treasury", 78, ("cross_border", "trade"), ("cross_border_exposure_link",), False),
    ("working capital", 76, ("growth", "expansion", "financing", "management_discussion"), (), False),
    ("term loan", 73, ("financing", "expansion", "acquisition", "m&a"), (), False),
    (
        "cash management", 72,
        ("growth", "expansion", "financing", "cross_border", "management_discussion"),
        ("cross_border_exposure_link",), False,
    ),
    ("capital markets", 68, ("market", "acquisition", "m&a"), (), False),
    ("risk review", 64, (), (), True),
)
LENS_LABELS = {
    "acquisition": "Client Acquisition",
    "financing": "Financing Need",
    "cross_border": "Cross-border Opportunity",
}
LENS_PRODUCTS = {
    "acquisition": ("working capital", "cash management", "capital markets", "cross-border payments"),
    "financing": ("working capital", "term loan", "cash management"),
    "cross_border": ("cross-border payments", "trade finance", "treasury"),
}
LENS_EVIDENCE_TYPES = {
    "acquisition": ("growth", "expansion", "acquisition", "m&a", "management_discussion", "market"),
    "financing": ("financing", "growth", "expansion"),
    "cross_border": ("cross_border", "trade"),
}
GOVERNANCE_FLAGS = (
    "high_priority_below_confidence_target",
    "priority_relies_on_contextual_linkage",
    "opportunity_context_overreach",
    "risk_not_explicit_in_next_step",
)
WORKFLOW_DEFAULTS = {"stage": "new", "status": "open", "review_status": "not_reviewed"}

# ---------------------------------------------------------------- fixed values: company matching

GENERIC_ALIASES = (
    "limited", "holdings", "holding", "group", "company", "co", "co.", "inc", "ltd", "bank", "corporation",
    "有限公司", "股份有限公司", "集团", "集團", "公司",
)
MARKET_SOURCES = {
    # source: (region, city, segments)
    "szse_cninfo": ("Mainland China", None, ("listed_company", "szse")),
    "hkex_disclosure": ("Hong Kong", "Hong Kong", ("listed_company", "hkex")),
}

# ---------------------------------------------------------------- fixed values: text extraction

NOISE_MARKERS = (
    "all rights reserved", "copyright", "member firm", "private english company limited by guarantee",
    "contact us", "table of contents", "contents", "kpmg.com", "www.", "http://", "https://",
)
METRIC_SPECS = (
    # name, pattern, percentages allowed
    ("revenue", r"(?:\brevenue\b|\bsales\b|\bturnover\b|营业收入|營業收入|营收|營收|收入)", False),
    ("net profit", r"(?:\bnet profit\b|\bprofit attributable\b|\bnet income\b|净利润|淨利潤|归母净利润|歸母淨利潤)", False),
    ("operating profit", r"(?:\boperating profit\b|\boperating income\b|\bebitda\b|营业利润|營業利潤)", False),
    ("total assets", r"(?:\btotal assets\b|\bassets under management\b|总资产|總資產)", False),
    ("loan book", r"(?:\bloan book\b|\bgross loans\b|\bcustomer loans\b|\bloan balance\b|贷款余额|貸款餘額)", False),
    (
        "customer deposits",
        r"(?:\bcustomer deposits\b|\bdeposit balance\b|\bdeposits\b|存款余额|存款餘額|客户存款|客戶存款)",
        False,
    ),
    ("npl ratio", r"(?:\bnpl ratio\b|\bnon-performing loan ratio\b|\bnonperforming loan ratio\b|不良贷款率|不良貸款率)", True),
    (
        "capital adequacy ratio",
        r"(?:\bcapital adequacy ratio\b|\bcapital ratio\b|\bcet1\b|\btier 1 ratio\b|资本充足率|資本充足率"
        r"|核心一级资本充足率|核心一級資本充足率|一级资本充足率|一級資本充足率)",
        True,
    ),
    ("cost-to-income ratio", r"(?:\bcost-to-income ratio\b|\bcost income ratio\b|成本收入比)", True),
    ("liquidity coverage ratio", r"(?:\bliquidity coverage ratio\b|\blcr\b|流动性覆盖率|流動性覆蓋率)", True),
)
METRIC_VALUE_PATTERN = (
    r"(?:(?:HK\$|US\$|RMB|CNY|\$)\s*)?"
    r"(?:[+-]?(?:\d[\d,]*(?:\.\d+)?|\.\d+))"
    r"(?:\s?(?:million|billion|trillion|bn|mn|m|%|亿港元|億元|億港元|亿元|萬元|万元|百万元|百萬元|万亿元|萬億元|亿|億))?"
)
METRIC_SCALE_PATTERN = r"(HK\$|US\$|RMB|CNY|\$|million|billion|trillion|bn|mn|亿港元|亿元|万元|百万元|万亿元)"
PERIOD_PATTERN = (
    r"\b(?:FY\s?20\d{2}|20\d{2}|Q[1-4]\s?20\d{2}|H[12]\s?20\d{2}|[1-4]Q20\d{2}|[1-4]季度|1-2月|1-3月|1-6月|1-9月)\b"
    r"|(?:20\d{2}年(?:上半年|下半年)?)"
)
USEFUL_PERIOD_PATTERN = r"(FY|Q[1-4]|H[12]|年|月)"
RISK_KEYWORDS = (
    ("regulatory", ("regulatory", "compliance", "investigation", "penalty", "监管", "監管", "合规", "合規", "处罚", "處罰", "牌照")),
    ("credit", ("credit risk", "default", "impairment", "bad debt", "non-performing", "违约", "違約", "减值", "減值", "坏账", "壞賬", "不良贷款", "不良貸款")),
    ("liquidity", ("liquidity", "funding", "cash flow", "refinancing", "流动性", "流動性", "融资", "融資", "现金流", "現金流")),
    ("market", ("volatility", "foreign exchange", "fx", "exchange rate", "rate hike", "devaluation", "波动", "波動", "汇率", "匯率", "利率风险", "利率風險")),
    ("operational", ("cyber", "outage", "supply chain", "operational risk", "network security", "网络", "網絡", "停摆", "停擺", "运营风险", "營運風險", "信息安全")),
    ("geopolitical", ("tariff", "geopolitical", "trade war", "出口管制", "地缘", "地緣", "制裁", "关税", "關稅")),
)
RISK_ANCHORS = (
    "risk", "risks", "exposure", "pressure", "uncertainty", "headwind", "challenge", "default", "impairment",
    "investigation", "penalty", "litigation", "illiquidity", "opacity", "风险", "風險", "压力", "壓力", "不确定",
    "不確定", "违约", "違約", "减值", "減值", "诉讼", "訴訟", "处罚", "處罰",
)
HIGH_SEVERITY_HINTS = ("material", "significant", "severe", "critical", "重大", "显著", "顯著", "严重", "嚴重")
EVENT_PATTERNS = (
    ("acquisition", (
        r"\b(?:acquired|acquire|acquisition|merged with|merger|takeover|agreed to acquire)\b",
        r"(?:收购|收購|并购|併購|合并|合併)",
    )),
    ("expansion", (
        r"\b(?:opened|launched|expanded|established|set up|invested in|rolled out)\b",
        r"(?:开设|開設|设立|設立|成立|启动|啟動|投建|扩张|擴張|扩展|擴展|拓展|推出|落地)",
    )),
    ("partnership", (
        r"\b(?:signed|entered into|announced|formed|agreed on)\b.{0,80}\b(?:partnership|agreement|collaboration|mou)\b",
        r"\b(?:partnership|agreement|collaboration|mou)\b.{0,80}\b(?:signed|entered into|announced|formed)\b",
        r"(?:签署|簽署|签订|簽訂|达成|達成).{0,40}(?:合作协议|合作協議|战略合作|戰略合作|合作备忘录|合作備忘錄|协议|協議|合作)",
    )),
    ("financing", (
        r"\b(?:raised|secured|obtained|issued|signed)\b.{0,80}\b(?:bond|facility|funding|financing|loan)\b",
        r"(?:融资|融資|授信|发债|發債|发行债券|發行債券|贷款安排|貸款安排)",
    )),
    ("regulatory", (
        r"\b(?:approved|received approval|licensed|granted a license|permit granted)\b",
        r"(?:获批|獲批|取得牌照|批准|许可|許可)",
    )),
    ("risk_alert", (
        r"\b(?:warning|impairment|default|litigation|dispute|going concern)\b",
        r"(?:风险提示|風險提示|减值|減值|诉讼|訴訟|违约|違約|纠纷|糾紛)",
    )),
)
EVENT_NEGATIVE_MARKERS = (
    "member firm", "all rights reserved", "private english company limited by guarantee", "hong kong (sar) partnership",
)
DATE_IN_TEXT_PATTERN = (
    r"\b(?:20\d{2}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}\s+[A-Z][a-z]{2,8}\s+20\d{2}|[A-Z][a-z]{2,8}\s+\d{1,2},\s+20\d{2})\b"
)
HTML_TAG_PATTERN = r"<(?:!doctype|html|body|head|title|meta|script|style|article|main|div|span|table)\b"
HEADING_HINTS = (
    "management discussion", "management's discussion", "md&a", "chairman", "chief executive", "overview",
    "business review", "financial highlights", "risk factors", "outlook", "strategy", "discussion", "analysis",
    "管理层讨论", "管理层討論", "业务回顾", "業務回顧", "财务摘要", "財務摘要", "风险因素", "風險因素", "前景",
)
DISCUSSION_HEADINGS = (
    "management discussion", "management's discussion", "management discussion and analysis", "md&a",
    "chairman's statement", "ceo message", "management review", "management commentary", "管理层讨论", "管理層討論",
    "管理层讨论与分析", "管理層討論與分析", "主席报告", "主席報告", "主席致辞", "主席致辭",
)
DISCUSSION_HIGHLIGHTS = (
    "growth", "strategy", "demand", "margin", "risk", "opportunity", "expansion", "pipeline", "regulatory",
    "liquidity", "增长", "增長", "战略", "戰略", "需求", "风险", "風險", "机会", "機會", "扩张", "擴張", "监管",
    "監管", "流动性", "流動性",
)
REPORT_TITLE_HINTS = (
    "annual report", "interim report", "outlook", "results", "earnings", "report", "年报", "年報", "半年报",
    "半年報", "季报", "季報", "报告", "報告",
)
DISCUSSION_FALLBACK_HEADINGS = (
    "overview", "sector outlook", "business review", "financial performance", "financial review",
    "operating review", "chairman", "ceo", "strategy", "management review", "discussion", "analysis", "概览",
    "概覽", "业务回顾", "業務回顧", "经营情况", "經營情況", "财务表现", "財務表現", "展望",
)
DISCUSSION_METADATA_MARKERS = (
    "adjunct size", "adjunct type", "announcement datetime", "announcement id", "announcement time", "pdf url",
    "stock code", "stock name",
)
PAGE_NOISE_PATTERNS = (
    r"^page\s+\d+$",
    r"\b(?:https?://|www\.|[\w.-]+\.com(?:/\S*)?)\b",
    r"all rights reserved",
    r"copyright",
    r"member firm",
    r"private english company limited by guarantee",
)
CANDIDATE_TITLE_MARKERS = (
    "management discussion", "management review", "business review", "financial review", "outlook", "strategy",
    "risk factors", "principal risks", "operating review", "liquidity", "capital", "管理层讨论", "管理層討論",
    "业务回顾", "業務回顧", "前景", "风险因素", "風險因素",
)
CANDIDATE_KEYWORD_MARKERS = (
    "cross-border", "cross border", "overseas", "new market", "expansion", "entered", "launched", "partnership",
    "funding", "financing", "liquidity", "capital support", "regulatory", "compliance", "licensing", "kyc", "跨境",
    "海外", "扩张", "擴張", "新市场", "新市場", "融资", "融資", "流动性", "流動性", "监管", "監管", "合规", "合規",
)
CANDIDATE_INTENT_MARKERS = (
    "entered a new market", "served a new geography", "merchant settlement", "payment acceptance",
    "capital planning", "working capital", "funding needs", "settlement controls", "regulatory reporting", "牌照",
    "營运资金", "營運資金", "结算", "結算",
)
GENERIC_FACT_PHRASES = (
    "strong momentum", "good opportunity", "positive outlook", "market opportunities", "business opportunities",
    "良好机遇", "良好機遇",
)
EVIDENCE_MIN_CONFIDENCE = 0.6

# ---------------------------------------------------------------- fixed values: retrieval

CHUNK_TOKENS = 800
CHUNK_OVERLAP = 100
RETRIEVAL_TOP_K = 6
RETRIEVAL_MIN_SCORE = 0.15
EVIDENCE_ITEMS_FOR_ANSWER = 5
EVIDENCE_CHARS_FOR_ANSWER = 700

# ---------------------------------------------------------------- fixed values: model-proposed facts

METRIC_NAME_ALIASES = (
    ("revenue", ("revenue", "sales", "turnover", "营业收入", "營業收入", "营收", "營收")),
    ("net profit", ("net profit", "net income", "净利润", "淨利潤")),
)
CANDIDATE_LIMIT = 8
METRIC_LIMIT, RISK_LIMIT, EVENT_LIMIT = 20, 12, 12  # what the reference keeps of a document
CANDIDATE_CHARS = 1200
CANDIDATE_MIN_CHARS = 40
REVIEW_ITEMS = 5
REVIEW_TEXT_CHARS = 220
