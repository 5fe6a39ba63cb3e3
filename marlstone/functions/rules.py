"""Rule classifiers, slots, compliance and rewriting for customer-service turns, as columns.

Every lexicon is a parameter; REFERENCE holds the Chinese one, FIXTURE one that fires on the synthetic tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import any_of, let


@dataclass(frozen=True)
class Route:
    """An intent and what calls for it: one of words, one of patterns ('.' is any character but a line feed), or one
    of each list of both."""

    intent: str
    words: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    both: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True)
class Lexicon:
    complaint: tuple[str, ...] = ()
    anxiety: tuple[str, ...] = ()
    confusion: tuple[str, ...] = ()
    topic_switch: tuple[str, ...] = ()
    confirm: tuple[str, ...] = ()
    flow_intents: tuple[str, ...] = ("buy_process", "hold_redeem")
    private: tuple[str, ...] = ()
    banned: tuple[str, ...] = ()
    products: tuple[str, ...] = ()
    types: tuple[tuple[str, str], ...] = ()
    references: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()
    strong: tuple[tuple[str, tuple[str, ...]], ...] = ()
    fallback: tuple[Route, ...] = ()
    new_topic: str = "(什么是|怎么|为什么|如何|哪些|哪里|有没有|是否)"
    greeting: tuple[str, ...] = ()


# Word lists of the rules.
REFERENCE = Lexicon(
    complaint=("投诉", "骗人", "骗子", "太差", "垃圾", "坑爹", "忽悠", "不满", "不满意", "什么玩意", "什么东西", "态度差", "曝光", "举报", "银保监会", "12378"),
    anxiety=("亏了", "亏损", "亏本金", "会不会亏", "会不会赔", "本金安全", "担心", "怕", "害怕", "睡不着", "焦虑", "紧张", "不踏实", "保本吗", "安全吗", "靠谱吗", "会不会跑路"),
    confusion=("没听懂", "听不懂", "什么意思", "再说一遍", "不明白", "看不懂", "不清楚", "怎么回事", "啥意思", "能解释一下"),
    topic_switch=("存款保险", "诈骗", "被骗", "投诉", "客服", "人工", "转人工", "基金", "保险", "黄金", "国债", "信托", "贷款", "信用卡", "手续费", "费率", "收益", "利率", "利息", "本金", "保本", "靠谱", "可靠", "安全吗", "风险"),
    confirm=("确认", "好的", "可以", "对", "嗯", "行", "没问题", "好", "是"),
    private=("我的", "查一下", "查查", "查询", "持仓", "我买", "我持有"),
    banned=("绝对", "保证", "一定", "百分百", "100%", "100％", "终身", "最便宜", "最低价", "全网最低", "第一", "最好", "顶级", "不会出错", "包您满意", "无条件退款", "随时退款", "绝对安全",
            "稳赚不赔", "稳赚", "零风险", "无风险", "保本高收益", "保底收益", "包赚", "一定赚", "保收益", "保证收益", "保证年化", "躺着赚钱", "百分百获利", "承诺保本"),
    types=(("存款", "存款"), ("大额存单", "存款"), ("结构性存款", "存款"), ("现金管理", "现金管理(货币类)"), ("货币", "现金管理(货币类)"), ("固收增强", "固收增强"), ("固定收益", "固定收益"),
           ("纯债", "公募基金(纯债, 代销)"), ("混合基金", "公募基金(偏股混合, 代销)"), ("增额", "保险(增额终身寿, 代销)"), ("终身寿", "保险(增额终身寿, 代销)"), ("年金", "保险(养老年金, 代销)"),
           ("保险", "保险"), ("基金", "基金"), ("理财", "理财")),
    references=("这个产品", "这款产品", "这款", "这个", "它们", "它"),
    strong=(("fraud_report", ("假理财", "飞单", "被骗", "诈骗", "内部高收益", "稳赚不赔", "内部渠道", "安全账户", "点击链接核实", "核实真伪", "高收益理财宣传", "内部理财渠道", "保本高收益")),
            ("complaint", ("投诉", "不满", "不满意", "太差了")),
            ("deposit_insurance", ("存款保险", "偿付限额", "受存款保险", "存款保险赔", "存款保险保障", "是存款吗", "算存款吗", "受保障吗", "受存款保障"))),
    fallback=(
        Route("fraud_report", ("假理财", "飞单", "被骗", "诈骗", "举报", "内部渠道", "内部高收益", "稳赚不赔"), ("高收益.{0,6}(可靠|真|假|吗|靠谱)", "(内部|私下|非正规|陌生).{0,6}(渠道|产品|理财|靠谱)")),
        Route("product_compare", ("对比", "区别", "哪个好", "哪个合适", "哪个适合", "哪个收益", "哪款好", "推荐"), ("和.{0,8}(哪个|哪款|比)",)),
        Route("complaint", ("投诉", "不满", "不满意")),
        Route("service_policy", ("转人工", "人工坐席", "人工客服", "客服会", "客服不会", "客服能", "服务范围", "客服边界", "隐私", "个人信息", "信息泄露", "工单")),
        Route("deposit_insurance", ("存款保险", "是存款吗", "是不是存款", "保不保", "受保护", "偿付", "保障范围"), (), (("50万",), ("赔", "保", "保障", "偿付"))),
        Route("risk_suitability", ("风险等级", "测评", "风险承受", "适当性"), ("(?U)\\br[1-5]\\b",), (("能买", "可以买", "适合买"), ("R", "风险", "测评", "等级", "稳健", "保守"))),
        Route("fee_rule", ("费率", "手续费", "管理费", "赎回费", "申购费"), (), (("费用",), ("收", "怎么算", "谁出", "多少", "收取"))),
        Route("hold_redeem", ("赎回", "到期", "净值", "撤单", "持仓", "提前支取")),
        Route("buy_process", ("怎么买", "购买", "申购", "流程", "门槛", "起购", "冷静期", "双录")),
        Route("income_question", ("收益", "年化", "利息", "保本", "亏损", "赚", "利率", "计息", "业绩比较基准")),
        Route("product_consult", ("日日盈", "现金管理", "稳盈", "添利", "安心固收", "固收", "平衡增利", "私银", "大额存单", "结构性存款", "纯债", "混合基金", "增额", "终身寿", "年金", "基金", "理财", "存款")),
        Route("chitchat", ("你是谁", "你是啥", "介绍一下你", "在吗", "你好呀", "你好", "您好", "谢谢", "hello", "hi")),
    ),
    greeting=("你好", "您好", "谢谢", "在吗", "hello", "hi"),
)
FIXTURE = Lexicon(
    complaint=("stupid", "thble"), anxiety=("tionth", "ungen"), confusion=("whthe", "queque"),
    topic_switch=("andthe", "lichder"), confirm=("The", "Der", "Le"), private=("eaouth", "heitder"), banned=("thst", "edea", "tion"),
    products=("ouble", "keiten", "ement"), types=(("thing", "deposit"), ("ung", "fund"), ("tion", "bond")), references=("this", "that", "it"),
    aliases=(("oner", "onerous"), ("ther", "thermal")),
    strong=(("fraud_report", ("whthe", "pfpf")), ("complaint", ("stupid", "edbl"))),
    fallback=(
        Route("product_compare", ("erer", "ungun")),
        Route("fee_rule", (), ("ble.{0,6}the",)),
        Route("income_question", ("inre", "stst"), (), (("ouble",), ("ement", "ungen"))),
        Route("chitchat", ("hele", "hein")),
    ),
    new_topic="(what|which|was)", greeting=("the", "der"),
)


def emotion(text: Column, negative_turns: Column, lex: Lexicon) -> Column:
    """complaint, anxiety, confusion or normal: the first list that fires; two negative turns make anxiety."""
    t = F.coalesce(text, F.lit(""))
    return F.when(any_of(t, lex.complaint), "complaint").when(any_of(t, lex.anxiety), "anxiety").when(any_of(t, lex.confusion), "confusion").when(negative_turns >= 2, "anxiety").otherwise("normal")


def suggest_handoff(mood: Column, turn_count: Column, negative_turns: Column) -> Column:
    return (mood == "complaint") | (negative_turns >= 2) | ((turn_count >= 3) & mood.isin("anxiety", "confusion"))


def greeting(text: Column, lex: Lexicon) -> Column:
    """Short texts that greet."""
    return (F.length(F.trim(text)) <= 12) & any_of(F.lower(text), lex.greeting)


def inherited_intent(text: Column, last_intent: Column, awaiting: Column, lex: Lexicon) -> Column:
    """The previous intent where a short follow-up keeps it, else null; the four rules in order."""
    q = F.trim(F.coalesce(text, F.lit("")))
    flow = F.coalesce(last_intent.isin(*lex.flow_intents), F.lit(False))
    starts = F.lit(False)
    for w in lex.confirm:
        starts = starts | F.startswith(q, F.lit(w))
    code = F.rlike(q, F.lit("(验证码|校验码|动态码|短信码)\\s*\\d{4,8}")) & (last_intent == "buy_process")
    amount = (awaiting == "amount") & F.rlike(q, F.lit("^\\s*\\d+(\\.\\d+)?\\s*(万|元|块|w|W)?\\s*$"))
    short = flow & (F.length(F.regexp_replace(q, "[，。？！、\\s]", "")) < 10) & ~F.rlike(q, F.lit(lex.new_topic))
    return F.when(last_intent.isNull() | (last_intent == "") | (q == "") | any_of(q, lex.topic_switch), F.lit(None).cast("string")).when(code, F.lit("buy_process")).when(flow & starts, last_intent).when(amount, last_intent).when(short, last_intent)


def strong_signal(text: Column, lex: Lexicon) -> Column:
    """Intent of the first strong list that fires, or null; its confidence is .92."""
    q = F.lower(text)
    out = F.lit(None).cast("string")
    for intent, words in reversed(lex.strong):
        out = F.when(any_of(q, words), F.lit(intent)).otherwise(out)
    return out


def fallback_intent(text: Column, lex: Lexicon) -> Column:
    """struct<intent, confidence>: the first route that fires on the text in lower case (.55), else unknown (.30)."""
    q = F.lower(F.coalesce(text, F.lit("")))

    def fires(r: Route) -> Column:
        hit = any_of(q, r.words)
        for p in r.patterns:
            hit = hit | F.rlike(q, F.lit("(?d)" + p))
        if r.both:
            every = F.lit(True)
            for words in r.both:
                every = every & any_of(q, words)
            hit = hit | every
        return hit

    out = F.struct(F.lit("unknown").alias("intent"), F.lit(0.30).alias("confidence"))
    for r in reversed(lex.fallback):
        out = F.when(fires(r), F.struct(F.lit(r.intent).alias("intent"), F.lit(0.55).alias("confidence"))).otherwise(out)
    return out


def fast_path(intent: Column, score: Column, text: Column, strong: Column, lex: Lexicon, informational: tuple[str, ...], least: float = 0.6) -> Column:
    """Name of the first gate that stops a fast answer, or pass."""
    return (
        F.when(strong.isin("fraud_report", "complaint"), "handoff")
        .when(any_of(F.coalesce(text, F.lit("")), lex.private), "private_data")
        .when(~F.coalesce(intent.isin(*informational), F.lit(False)), "intent_not_informational")
        .when(F.coalesce(score, F.lit(0.0)) < least, "no_kb_evidence")
        .otherwise("pass")
    )


def mask_pii(text: Column) -> Column:
    """Phones, ids and card numbers masked, first three and last four characters kept."""
    t = F.regexp_replace(text, r"(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)", "$1****$2")
    t = F.regexp_replace(t, r"(?<!\d)(\d{3})\d{11}(\d{3}[\dXx])(?!\d)", "$1" + "*" * 11 + "$2")
    cards = t
    for n in range(13, 20):
        cards = F.regexp_replace(cards, rf"(?<!\d)(\d{{3}})\d{{{n - 7}}}(\d{{4}})(?!\d)", "$1" + "*" * (n - 7) + "$2")
    return F.when(F.rlike(t, F.lit(r"\d{13}")), cards).otherwise(t)


def banned_hits(text: Column, words: tuple[str, ...]) -> Column:
    """Banned words that text contains, in list order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def mask_words(text: Column, words: tuple[str, ...]) -> Column:
    """Each banned word that text contains starred over, one after the other."""
    return F.aggregate(banned_hits(text, words), text, lambda t, w: F.replace(t, w, F.repeat(F.lit("*"), F.length(w))))


DISCLAIMER = "温馨提示：理财/基金/保险非存款，产品有风险，投资须谨慎；业绩比较基准、历史收益等仅为参考，不构成收益承诺。"


def needs_risk_note(text: Column) -> Column:
    """A product and its yield are spoken of, and no warning is."""
    t = F.coalesce(text, F.lit(""))
    return any_of(t, ("理财", "基金", "保险", "业绩比较基准")) & any_of(t, ("收益", "基准", "年化", "利率", "增值", "返还")) & ~any_of(t, ("风险", "非存款", "不构成", "谨慎", "温馨提示", "提示"))


def comply(text: Column, words: tuple[str, ...]) -> Column:
    """struct<clean, hits, masked, final>: outbound check."""
    t = F.coalesce(text, F.lit(""))

    def of(m: Column) -> Column:
        final = F.when(needs_risk_note(t), F.concat(F.rtrim(m), F.lit("\n\n" + DISCLAIMER))).otherwise(m)
        return F.struct(((F.size(banned_hits(t, words)) == 0) & (m == t)).alias("clean"), banned_hits(t, words).alias("hits"), m.alias("masked"), final.alias("final"))

    return let(mask_pii(mask_words(t, words)), of)


def slots(text: Column, lex: Lexicon) -> Column:
    """struct<product, product_type, amount, amount_raw, term, risk_level> of a question; null where nothing fits."""
    q = F.coalesce(text, F.lit(""))
    product = F.coalesce(*[F.when(F.contains(q, F.lit(p)), F.lit(p)) for p in sorted(lex.products, key=lambda p: (-len(p), p))], F.lit(None).cast("string"))
    kind = F.coalesce(*[F.when(F.contains(q, F.lit(k)), F.lit(v)) for k, v in lex.types], F.lit(None).cast("string"))
    money = "(\\d+(?:\\.\\d+)?)\\s*(万|w|元)"
    number = F.nullif(F.regexp_extract(q, money, 1), F.lit("")).cast("double")
    amount = F.when(F.regexp_extract(q, money, 2) == "元", number / 10000).otherwise(number)
    span = "(\\d+(?:\\.\\d+)?)\\s*(天|个月|月|年)"
    unit = F.regexp_extract(q, span, 2)
    term = F.when(unit != "", F.concat(F.regexp_extract(q, span, 1), F.when(unit == "月", "个月").otherwise(unit)))
    risk = F.nullif(F.regexp_extract(q, "(?i)R([1-5])(?!\\d)", 1), F.lit(""))
    return F.struct(product.alias("product"), kind.alias("product_type"), amount.alias("amount"), F.nullif(F.regexp_extract(q, money, 0), F.lit("")).alias("amount_raw"), term.alias("term"), F.concat(F.lit("R"), risk).alias("risk_level"))


def missing_slots(intent: Column, slot: Column) -> Column:
    """Slots to ask for: the product, when an order names an amount without one."""
    return F.when((intent == "buy_process") & slot["amount"].isNotNull() & slot["product"].isNull(), F.array(F.lit("product"))).otherwise(F.array().cast("array<string>"))


def enters_subscription(intent: Column, text: Column, slot: Column, code: str = r"\b(\d{6})\b", handoff: tuple[str, ...] = ("fraud_report", "complaint")) -> Column:
    """Whether a turn is an order: it names a product (slot) and either is to buy with an amount, or asks about products
    and holds the code that was asked for. Intents that are handed over never are."""
    order = (intent == "buy_process") & slot["amount"].isNotNull()
    confirm = (intent == "product_consult") & F.rlike(F.coalesce(text, F.lit("")), F.lit(code))
    return F.coalesce(slot["product"].isNotNull() & (slot["product"] != "") & ~intent.isin(*handoff) & (order | confirm), F.lit(False))


# Product types and intents of each product domain.
DOMAIN_OF_TYPE = {"存款": "deposit", "结构性存款": "deposit", "现金管理": "wealth", "固定收益": "wealth", "固收增强": "wealth", "私银混合": "wealth", "公募基金": "fund", "保险": "insurance", "债券": "bond", "信托": "trust", "贵金属": "gold"}


def domain(product_type: Column, of_type: dict[str, str] | None = None) -> Column:
    """Product domain of a type (its part before a parenthesis); common where none is known."""
    m = F.create_map(*[F.lit(x) for kv in (of_type or DOMAIN_OF_TYPE).items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.trim(F.substring_index(F.coalesce(product_type, F.lit("")), "(", 1))), F.lit("common"))


def rewrite(text: Column, product: Column, lex: Lexicon) -> Column:
    """References to the product in focus replaced by it, then aliases by full names, longest first."""
    q = F.trim(F.coalesce(text, F.lit("")))
    out = q
    for w in lex.references:
        out = F.when(product.isNotNull() & ~F.contains(q, product), F.replace(out, F.lit(w), product)).otherwise(out)
    for a, full in sorted(lex.aliases, key=lambda x: -len(x[0])):
        out = F.when(F.contains(out, F.lit(a)) & ~F.contains(out, F.lit(full)), F.replace(out, F.lit(a), F.lit(full))).otherwise(out)
    return out


def multi_question(text: Column, connectors: str = "另外|还有|以及|同时|顺便") -> Column:
    """Two question marks or more, or a connector."""
    marks = F.length(text) - F.length(F.translate(text, "?？", ""))
    return (marks >= 2) | F.rlike(text, F.lit(connectors))


# Words of a direction, in the order they are looked for.
TREND = (("增长", "up"), ("上升", "up"), ("下降", "down"), ("下滑", "down"), ("持平", "stable"), ("波动", "volatile"))


def trend(text: Column, words: tuple[tuple[str, str], ...] = TREND) -> Column:
    """Direction of the first word of the list that the first 200 characters hold; unknown without one."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 200)
    return F.coalesce(*[F.when(F.contains(head, F.lit(w)), F.lit(d)) for w, d in words], F.lit("unknown"))


# Names of secrets in log lines, what their values end at, and what stands for them.
SECRETS = (("api_key", "\"'\\s"), ("password", "\"'\\s"), ("token", "\"'\\s,}"))
REDACTED = "***REDACTED***"


def redact(line: Column, secrets: tuple[tuple[str, str], ...] = SECRETS) -> Column:
    """Log line with the values of secrets redacted, in plain lines and quoted as JSON: name, colon or equals sign, value."""
    for name, ends in secrets:
        line = F.regexp_replace(line, f"(?i)({name}[\"']?\\s*[:=]\\s*[\"']?)[^{ends}]+", f"$1{REDACTED}")
    return line


def shipping_fee(total: Column, free_from: float = 99.0, fee: float = 8.0) -> Column:
    return F.when(total >= free_from, F.lit(0.0)).otherwise(F.lit(fee))


def refundable(ordered: Column, asked: Column, days: int = 7) -> Column:
    return F.datediff(asked, ordered).between(0, days)
