"""Ordered rule tables. Keywords and codes of the record formats, in order; the first rule that fits wins."""

from __future__ import annotations

HOLDINGS = (
    (("现金及活期",), "CASH"),
    (("现金管理",), "CASH"),
    (("固定收益",), "FIXED_INCOME"),
    (("债券",), "FIXED_INCOME"),
    (("权益",), "FUND"),
    (("私募",), "PRIVATE_EQUITY"),
    (("家族信托",), "TRUST"),
    (("慈善信托",), "TRUST"),
    (("不动产",), "REAL_ESTATE"),
)
EVENTS = (
    (("减持",), "DIVESTMENT"),
    (("赎回",), "DIVESTMENT"),
    (("追加",), "INVESTMENT"),
    (("投资",), "INVESTMENT"),
    (("捐赠",), "DONATION"),
    (("注入",), "DONATION"),
    (("转配",), "INVESTMENT"),
)
EVENTS_AGAIN = (
    (("分红",), "DIVIDEND_INCOME"),
    (("增持", "购买", "投资"), "INVESTMENT"),
    (("赠与",), "ASSET_GIFT"),
    (("处置", "减持"), "DIVESTMENT"),
    (("偿还",), "DEBT_REPAYMENT"),
    (("置换",), "ASSET_RESTRUCTURING"),
)
NOTES = (
    (("明确表示", "重点关注", "需要"), "EXPLICIT_NEED"),
    (("偏好", "喜欢", "不喜", "重视"), "PREFERENCE"),
    (("沟通",), "COMMUNICATION_STYLE"),
)
ENTERPRISE_EVENTS = (
    (("处罚", "监管", "整改", "诉讼", "司法", "调查", "合规"), "REGULATORY_OR_LEGAL"),
    (("高管", "董事长", "任董事会", "管理层", "连任"), "CORPORATE_GOVERNANCE"),
)
CAPITAL = (("回购", "融资", "质押", "增发", "分拆", "投资", "收购", "并购", "担保", "分红"), "CAPITAL_OPERATION")
EVENT_RISK = ((("处罚", "诉讼", "司法", "调查", "质押", "整改", "承压"), "MEDIUM"),)
MARKET = (("上游", "UPSTREAM"), ("下游", "DOWNSTREAM"), ("竞争对手", "COMPETITOR"))
FAMILY = {"父亲": "FATHER", "母亲": "MOTHER", "妻子": "SPOUSE", "丈夫": "SPOUSE", "儿子": "SON", "女儿": "DAUGHTER", "姐姐": "SIBLING", "妹妹": "SIBLING", "哥哥": "SIBLING", "弟弟": "SIBLING", "兄弟": "SIBLING", "姐妹": "SIBLING"}
SUCCESSION = (
    (("暂无明确", "无明确", "暂未", "未进入"), "NO_FORMAL_SUCCESSOR"),
    (("已接班", "已确定", "明确接班"), "SUCCESSOR_IDENTIFIED"),
)
GOVERNANCE = {
    "PROTECTION": ((("教育信托",), "EDUCATION_TRUST_AND_INSURANCE"), (("保险",), "INSURANCE_PROTECTION")),
    "WEALTH": ((("信托",), "FAMILY_TRUST"), (("遗嘱",), "WILL_AND_INHERITANCE_PLAN")),
    "CORPORATE": ((("职业经理人",), "PROFESSIONAL_MANAGER_GOVERNANCE"), (("合伙人制度",), "PARTNERSHIP_GOVERNANCE"), (("家族",), "FAMILY_GOVERNANCE")),
}
ROLES = ("董事会主席", "理事会主席", "联合主席", "名誉会长", "副理事长", "副主席", "董事会成员", "副会长", "会长", "主席", "副理事", "理事", "校董", "代表", "顾问", "发起人", "董事", "成员")
ORGANIZATIONS = (
    (("基金会",), "FOUNDATION"),
    (("大学", "学院", "实验室", "研究院", "中科院", "达摩院"), "ACADEMIC"),
    (("协会", "商会", "俱乐部", "联盟", "总会", "论坛"), "INDUSTRY_ASSOCIATION"),
    (("人大", "联合国", "政府"), "PUBLIC_INSTITUTION"),
)
ESG = (("ESG", "碳中和", "碳排放"), "ESG")
REPUTATION = ((("媒体形象", "媒体关注", "公众视野"), "MEDIA_ATTENTION"),)
PUBLISHERS = ((("时代",), "TIME"), (("福布斯",), "FORBES"), (("CCTV",), "CCTV"))
REPUTATION_RISK = ((("处罚", "调查", "诉讼", "被叫停", "数据安全", "反垄断"), "MEDIUM"),)
CONTROL = (
    (("创办", "创始人"), "FOUNDER"),
    (("董事长",), "CHAIRPERSON"),
    (("实际控制人", "绝对控制"), "CONTROLLING_SHAREHOLDER"),
)
SPECULATION = ("推测", "可能", "据传", "传闻", "疑似", "或许", "未证实", "网传")
NULLS = ("", "-", "--", "/", "n/a", "na", "none", "null", "unknown", "未公开", "暂无", "不详", "未知", "无数据", "未披露")
CURRENCIES = {"人民币": "CNY", "人民币元": "CNY", "rmb": "CNY", "cny": "CNY", "港元": "HKD", "港币": "HKD", "hkd": "HKD", "美元": "USD", "usd": "USD"}
SYMBOLS = (("HK$", "HKD"), ("$", "USD"), ("¥", "CNY"), ("￥", "CNY"))
UNITS = (("元", 1), ("千元", 10**3), ("万元", 10**4), ("百万元", 10**6), ("千万元", 10**7), ("亿元", 10**8), ("千", 10**3), ("万", 10**4), ("百万", 10**6), ("千万", 10**7), ("亿", 10**8))
ESTIMATES = ("不低于", "大约", "超过", "至少", "约", "近")
MARITAL = {"已婚": "MARRIED", "未婚": "UNMARRIED", "离异": "DIVORCED", "丧偶": "WIDOWED"}
PERSON_ENTERPRISE = {"CHAIRPERSON": "CHAIRMAN_OF", "CHAIRMAN": "CHAIRMAN_OF", "CEO": "CEO_OF", "CHIEF_EXECUTIVE": "CEO_OF", "FOUNDER": "FOUNDED", "WORKS_AT": "WORKS_AT", "EMPLOYEE": "WORKS_AT", "SHAREHOLDER": "HOLDS_SHARE", "ACTUAL_CONTROLLER": "CONTROLS", "CONTROLLER": "CONTROLS", "CORE_ASSOCIATED": "RELATED_TO"}
SOCIAL = {"MEMBER": "MEMBER_OF", "MEMBER_OF": "MEMBER_OF", "ORGANIZATION_MEMBERSHIP": "MEMBER_OF", "EMPLOYMENT": "WORKS_FOR", "WORKS_FOR": "WORKS_FOR", "PUBLIC_ROLE": "RELATED_TO"}
TITLES = ((("董事长", "主席"), "CHAIRMAN_OF"), (("首席执行官", "CEO"), "CEO_OF"), (("创始人", "创办人"), "FOUNDED"))
FINANCIAL_EVENTS = ("INVESTMENT", "FINANCING", "DONATION", "DIVESTMENT", "DIVIDEND", "DEBT_REPAYMENT", "GIFT", "SHARE_INCREASE", "SHARE_DECREASE")
STRICT_RELATIONS = ("CONTROLS", "HOLDS_SHARE")
CONFIRMED = ("CONFIRMED", "VERIFIED", "CONFIRMED_BY_HUMAN")
#: Codes of texts by subject: all rules of which a keyword occurs, in order; English words need boundaries.
SEMANTIC = {
    "INTERACTION": {
        "LONG_TERM_PLANNING": ("长期", "长期规划", "long term"),
        "DIGITAL_TECHNOLOGY": ("人工智能", "ai", "科技", "数字化", "互联网"),
        "WEALTH_MANAGEMENT": ("财富", "资产配置", "投资"),
        "PHILANTHROPY": ("公益", "慈善", "捐赠"),
        "CROSS_BORDER": ("跨境", "海外", "国际"),
    },
    "BUSINESS": {
        "DIGITAL_PLATFORM": ("社交", "平台", "互联网", "online platform"),
        "DIGITAL_CONTENT": ("游戏", "内容", "娱乐", "music", "video"),
        "FINTECH_ENTERPRISE_SERVICE": ("金融科技", "支付", "企业服务", "fintech"),
        "CLOUD_COMPUTING": ("云计算", "云服务", "云平台", "云业务", "上云", "cloud"),
        "ARTIFICIAL_INTELLIGENCE": ("人工智能", "ai", "大模型"),
        "MANUFACTURING": ("制造", "工业", "自动化", "manufacturing"),
    },
    "ENTERPRISE_EVENT": {
        "SHARE_REPURCHASE": ("回购", "repurchase", "buyback"),
        "AI_STRATEGY": ("人工智能", "ai", "大模型"),
        "REGULATORY_ACTION": ("监管", "处罚", "罚款", "合规", "antitrust"),
        "OPERATING_LICENSE": ("牌照", "许可", "license"),
        "PROFIT_GROWTH": ("利润增长", "业绩增长", "增长", "profit growth"),
        "INDUSTRY_TRANSFORMATION": ("转型", "重组", "transform"),
    },
    "ACTIVITY": {
        "PHILANTHROPY": ("公益", "慈善", "捐赠", "基金会"),
        "EDUCATION_SUPPORT": ("教育", "学校", "奖学金"),
        "RESEARCH_SUPPORT": ("研究", "科研", "实验室"),
        "ESG_SUSTAINABILITY": ("esg", "可持续", "环保", "低碳"),
    },
    "REPUTATION": {
        "GLOBAL_INFLUENCE": ("全球", "国际", "world", "global"),
        "BUSINESS_LEADERSHIP": ("企业家", "领袖", "leader"),
        "WEALTH_RANKING": ("富豪", "财富榜", "ranking", "rich list"),
        "TECHNOLOGY_LEADERSHIP": ("科技", "人工智能", "数字", "technology"),
    },
    "REPUTATION_RISK": {
        "ANTITRUST": ("反垄断", "垄断", "antitrust"),
        "DATA_SECURITY": ("数据安全", "隐私", "个人信息", "data security"),
        "MINOR_PROTECTION": ("未成年", "青少年", "minor"),
        "CONTENT_GOVERNANCE": ("内容", "算法", "推荐", "content"),
        "LABOR_PRACTICE": ("劳动", "员工", "劳工", "labor"),
        "INVESTMENT_EXPANSION": ("投资", "并购", "扩张", "acquisition"),
    },
    "ROLE": {
        "BOARD_GOVERNANCE": ("董事", "board"),
        "EXECUTIVE_LEADERSHIP": ("ceo", "总裁", "主席", "创始人", "executive"),
        "FINANCIAL_MANAGEMENT": ("财务", "cfo", "finance"),
        "ADVISORY": ("顾问", "advisor"),
    },
    "INDUSTRY": {
        "INTERNET_TECHNOLOGY": ("互联网", "软件", "科技", "digital"),
        "FINANCIAL_SERVICES": ("金融", "银行", "保险", "finance"),
        "MANUFACTURING": ("制造", "工业", "manufacturing"),
        "REAL_ESTATE": ("房地产", "地产", "real estate"),
        "HEALTHCARE": ("医疗", "医药", "health"),
    },
    "ASSET": {
        "PUBLIC_EQUITY": ("股票", "股权", "equity"),
        "FIXED_INCOME": ("债券", "固收", "bond"),
        "FUND": ("基金", "fund"),
        "INSURANCE": ("保险", "insurance"),
        "PRIVATE_MARKET": ("私募", "private"),
        "CASH": ("现金", "存款", "cash"),
    },
    "GOVERNANCE": {
        "FAMILY_GOVERNANCE": ("家族", "family"),
        "TRUST_STRUCTURE": ("信托", "trust"),
        "PROFESSIONAL_MANAGEMENT": ("职业经理", "professional management"),
        "BOARD_GOVERNANCE": ("董事会", "board"),
    },
}
#: Codes of profile fields: the first rule that fits.
FIELD_CODES = {
    "gender": ((("男", "男性"), "MALE"), (("女", "女性"), "FEMALE")),
    "maritalStatus": ((("未婚",), "UNMARRIED"), (("已婚", "婚姻"), "MARRIED"), (("离异", "离婚"), "DIVORCED"), (("丧偶",), "WIDOWED")),
    "educationLevel": ((("博士",), "DOCTORATE"), (("硕士", "研究生"), "MASTER"), (("本科", "学士"), "BACHELOR"), (("大专", "专科"), "COLLEGE"), (("高中", "中专"), "HIGH_SCHOOL")),
    "healthStatus": ((("良好", "健康", "正常"), "GOOD"), (("一般", "稳定"), "STABLE"), (("疾病", "欠佳", "异常", "治疗"), "HEALTH_CONCERN")),
    "investmentHorizon": ((("长期", "5年以上", "五年以上"), "LONG_TERM"), (("中期", "3-5", "三至五"), "MEDIUM_TERM"), (("短期", "1年", "一年"), "SHORT_TERM")),
    "liquidityRequirement": ((("不高", "较低", "低流动"), "LOW"), (("很高", "较高", "高流动", "随时"), "HIGH"), (("中等", "适中", "一般"), "MEDIUM")),
    "actualPreference": ((("股票", "权益", "股权"), "EQUITY"), (("债券", "固收"), "FIXED_INCOME"), (("私募", "另类"), "PRIVATE_MARKET"), (("现金", "存款"), "CASH"), (("均衡", "多元", "组合"), "BALANCED")),
    "metricName": ((("总营收", "营收", "营业收入"), "TOTAL_REVENUE"), (("净利润", "归母净利润"), "NET_PROFIT"), (("毛利率",), "GROSS_MARGIN"), (("净利率",), "NET_MARGIN"), (("总资产",), "TOTAL_ASSETS"), (("总负债",), "TOTAL_LIABILITIES"), (("经营现金流",), "OPERATING_CASH_FLOW")),
}
#: Full names of places that are given in short.
PLACES = {
    "北京": "北京市", "上海": "上海市", "天津": "天津市", "重庆": "重庆市", "深圳": "深圳市", "广州": "广州市", "杭州": "杭州市",
    "河北": "河北省", "山西": "山西省", "辽宁": "辽宁省", "吉林": "吉林省", "黑龙江": "黑龙江省", "江苏": "江苏省", "浙江": "浙江省", "安徽": "安徽省",
    "福建": "福建省", "江西": "江西省", "山东": "山东省", "河南": "河南省", "湖北": "湖北省", "湖南": "湖南省", "广东": "广东省", "海南": "海南省",
    "四川": "四川省", "贵州": "贵州省", "云南": "云南省", "陕西": "陕西省", "甘肃": "甘肃省", "青海": "青海省", "台湾": "台湾省",
    "内蒙古": "内蒙古自治区", "广西": "广西壮族自治区", "西藏": "西藏自治区", "宁夏": "宁夏回族自治区", "新疆": "新疆维吾尔自治区", "香港": "香港特别行政区", "澳门": "澳门特别行政区",
}
