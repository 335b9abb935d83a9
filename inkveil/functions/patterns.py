"""What counts as a date, a name, an address, a number: word lists and patterns.

Patterns are in the dialect of Python's re; java() turns one into an equal pattern for Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import factors
from .text import Gate

# They must be these for masked texts to be the expected ones.
PREFECTURES = (
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県",
    "新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県", "滋賀県", "京都府", "大阪府", "兵庫県",
    "奈良県", "和歌山県", "鳥取県", "島根県", "岡山県", "広島県", "山口県", "徳島県", "香川県", "愛媛県", "高知県", "福岡県", "佐賀県", "長崎県",
    "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
)
OFFICES = ("支社", "支店", "営業所", "オフィス", "本社", "拠点", "工場", "センター", "倉庫", "事業所")
ERAS = {"令和": 2018, "平成": 1988, "昭和": 1925, "大正": 1911, "明治": 1867, "R": 2018, "H": 1988, "S": 1925, "T": 1911, "M": 1867}
TITLES = (
    "代表取締役社長", "代表取締役副社長", "代表取締役", "取締役社長", "取締役副社長", "取締役会長", "取締役", "執行役員", "監査役", "副社長", "会長", "社長", "頭取", "総裁", "理事長", "専務", "常務",
    "本部長", "事業部長", "副部長", "部長", "担当課長", "課長", "係長", "主任", "グループ長", "チームリーダー", "マネージャー", "ディレクター",
    "主任研究員", "研究員", "教授", "准教授", "講師", "博士", "公認会計士", "弁理士", "弁護士", "税理士", "司法書士", "医師",
    "President", "Director", "Manager", "CEO", "CFO", "COO", "CTO", "CMO", "CISO", "さん", "様", "氏", "君", "ちゃん", "殿", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Mr", "Mrs", "Ms", "Dr", "Prof",
)
SURNAMES = (
    "佐々木", "長谷川", "久保田", "小野寺", "五十嵐",
    "田中", "鈴木", "佐藤", "高橋", "伊藤", "渡辺", "山本", "中村", "小林", "加藤", "吉田", "山田", "山口", "松本", "井上", "木村", "斎藤", "清水", "山崎", "阿部",
    "池田", "橋本", "山下", "石川", "中島", "前田", "藤田", "後藤", "岡田", "村上", "近藤", "石井", "坂本", "遠藤", "青木", "藤井", "西村", "福田", "太田", "三浦",
    "岡本", "松田", "中川", "中野", "原田", "小川", "竹内", "金子", "和田", "中山", "藤原", "石田", "上田", "森田", "松井", "菊池", "宮崎", "渡部", "岩田", "久保",
    "野口", "大野", "中田", "村田", "武田", "横山", "野村", "安藤", "松尾", "今井", "内田", "水野", "江口", "松下", "黒田", "小野", "吉川", "上野", "大島", "田村",
    "桜井", "川口", "萩原", "菅原", "角田", "栗田", "栗原", "栗山", "永田", "永井", "永野", "川上", "川田", "宮田", "宮本", "宮下", "宮川", "宮野", "宮島", "宮内",
    "伊東", "伊野", "伊原", "伊沢", "松岡", "松村", "松浦", "岩崎", "岩本", "岸本", "岸田", "小島", "小松", "大西", "大田", "大山", "大石", "大塚",
    "河野", "河田", "河合", "川村", "川本", "川島", "新田", "新井", "新村", "浜田", "浜野", "田島", "田原", "田口", "辻", "辻本", "塩田", "塩野", "長田", "長野",
    "織田", "豊臣", "徳川", "足利", "北条", "今川", "上杉", "毛利", "島津", "伊達", "源", "平", "森", "林",
)
COMPANY_FORMS = (
    "代表取締役社長", "株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "一般社団法人", "公益社団法人", "一般財団法人", "公益財団法人", "独立行政法人", "国立研究開発法人", "社会福祉法人", "医療法人",
    "特定非営利活動法人", "NPO法人", "学校法人", "宗教法人", "ホールディングス", "コーポレーション", "エンタープライズ", "グループ", "Inc.", "Corp.", "Ltd.", "LLC", "LLP", "Co.", "GmbH", "AG", "plc",
    "信用金庫", "銀行", "証券", "保険", "信託",
)
LEADING_FORMS = ("株式会社", "有限会社", "合同会社", "一般社団法人", "一般財団法人", "特定非営利活動法人")


def _any(words) -> str:
    return "|".join(map(re.escape, words))


def first_letters(words) -> str:
    """A lookahead that most characters of a text fail at once: what any of the words begins with, if ASCII, or any character that isn't."""
    ascii_letters = "".join(sorted({w[0] for w in words if w[0].isascii()}))
    return rf"(?=[^\x00-\x7F]|[{ascii_letters}])" if ascii_letters else r"(?=[^\x00-\x7F])"


def _longest(words) -> list[str]:
    """Longest first; equal lengths in order of code points, so that results don't depend on chance."""
    return sorted(set(words), key=lambda w: (-len(w), w))


_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_NUMERAL = r"[０-９\d〇一二三四五六七八九十]"
_ERA = r"(?:令和|平成|昭和|大正|明治)"


def _separated(mark: str) -> str:
    return rf"(?<!\d)[12１２][0-9０-９]{{3}}{mark}[01０１]?[0-9０-９]{mark}[0-3０-３]?[0-9０-９](?!\d)"


#: Forms of dates: name, pattern, whether a word of DATE_CONTEXT must be near, and what a text must hold for a match.
DATE_FORMS = (
    ("kanji", rf"{_ERA}?\s*{_NUMERAL}{{1,4}}年\s*{_NUMERAL}{{1,2}}月(?:\s*{_NUMERAL}{{1,2}}日)?", False, "年"),
    ("slash", _separated("[/／]"), False, "[/／]"),
    ("hyphen", _separated("[-－]"), False, "[-－]"),
    ("dot", _separated(r"[\.．]"), False, r"[\.．]"),
    ("digits", r"(?<![\dA-Za-z\-])20[2-9][0-9][01][0-9][0-3][0-9](?![\dA-Za-z\-])", False, "20[2-9]"),
    ("month_day", rf"(?<!\d){_NUMERAL}{{1,2}}月\s*{_NUMERAL}{{1,2}}日", False, "月"),
    ("english", rf"(?:{_MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH}\.?\s+\d{{4}})", False, rf"{_MONTH}\.?\s"),
    ("era", r"(?<![A-Za-z0-9_])[RHTMS]\d{1,2}[\.．][01]?\d[\.．][0-3]?\d(?!\d)", False, r"[RHTMS]\d"),
    ("short", r"(?<!\d)[01]?\d[/／][0-3]?\d(?!\d)", True, r"\d[/／]"),
)
DATE_CONTEXT = (
    r"(?:年|月|日|date|dated?|as\s+of|on\s+the|〜|から|まで|期限|締切|締め切り|納期|予定|時点|以降|以前|当日|翌日|前日|開始|終了|発効|有効|期日|schedule|due|deadline|effective|expir)"
)
CONTEXT_WIDTH = 50

_KANJI, _KANA = r"[一-鿿]", r"[぀-ゟ゠-ヿ]"
TITLED_NAME = rf"(?:{_KANJI}{{2,4}}(?:{_KANA}{{1,4}})?|[A-Z][a-z]{{1,14}}(?:\s[A-Z][a-z]{{1,14}})?)(?={first_letters(TITLES)}(?:{_any(_longest(TITLES))}))"
GIVEN_NAME = rf"{_KANJI}{{1,3}}(?:{_KANA}{{1,4}})?"
_BODY = r"[一-鿿a-zA-Z0-9゠-ヿ\-・]{2,30}"
COMPANY = rf"(?:(?:{_any(LEADING_FORMS)})\s*{_BODY}|{_BODY}{first_letters(COMPANY_FORMS)}(?:{_any(_longest(COMPANY_FORMS))}))"
ORDERED_SURNAMES = tuple(_longest(SURNAMES))


@dataclass(frozen=True)
class Rule:
    """pattern; pre and suf: patterns of what stays before and after the token; gate: what a text must hold for a match (none: derived from the pattern, see factors)."""

    name: str
    category: str
    pattern: str
    gate: str | None = None
    pre: str | None = None
    suf: str | None = None


_PLACE = r"[^\s　、。\n]"
_STEMS = tuple(p.rstrip("都道府県") for p in PREFECTURES)  # of characters: 京都府 has the stem 京
_UNITS = (
    r"kg|g(?!円)|mg|t(?!円)|km|cm|mm|μm|nm|m(?!円|月|日|分|名|枚)|mL|ml|㎥|m²|m3|m2|L(?!円)|W(?!円)|kW|MW|V(?!円)|A(?!円)|Hz|dB|kWh|Wh|℃|°C|°F|K(?!円)"
    r"|rpm|bps|Mbps|Gbps|kbps|TB|GB|MB|KB|個|本|枚|台|件|冊|式|セット|箱|袋|缶|時間|秒(?!間)|分(?!間|円|岐)|人(?!分)|名(?!円)|社(?!円)|店(?!円)"
)
RULES = (
    Rule("full_date", "日付", r"\d{4}年\d{1,2}月(?:\d{1,2}日)?", "年"),
    Rule("iso_date", "日付", r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"\d{4}[-/]"),
    Rule("month_day", "日付", r"(?<!\d)\d{1,2}月\d{1,2}日", "月"),
    Rule("era_date", "日付", _ERA + r"\d+年\d{1,2}月(?:\d{1,2}日)?", "年"),
    Rule("postal", "住所", rf"〒\s*\d{{3}}[-－]\d{{4}}(?:\s*(?:{_any(PREFECTURES)}))?(?:{_PLACE}{{1,50}})?", "〒", pre="〒"),
    Rule("prefecture", "住所", rf"(?:{_any(PREFECTURES)}){_PLACE}{{2,60}}", "[都道府県]", pre=f"^(?:{_any(PREFECTURES)})"),
    Rule("city", "住所", rf"{_PLACE}{{2,6}}(?:市|区|町|村){_PLACE}{{1,40}}", "[市区町村]"),
    Rule("building", "住所", rf"{_PLACE}{{1,20}}(?:ビル(?:ディング)?|タワー|マンション|アパート|ハイツ|コーポ|レジデンス|プラザ|センター|ホール|スクエア)(?:\d+館)?(?:\s*(?:\d+F|\d+階|\d+号室|[A-Za-z]?\d+))?", "ビル|タワー|マンション|アパート|ハイツ|コーポ|レジデンス|プラザ|センター|ホール|スクエア"),
    Rule("branch", "住所", rf"(?:{_any(_STEMS)})(?:{_any(OFFICES)})", _any(OFFICES), suf=f"(?:{_any(OFFICES)})$"),
    Rule("mail", "メール", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "@"),
    Rule("social", "SNS", r"(?:@[\w\-\.]{1,50}|(?:twitter|x|instagram|facebook)\.com/[\w\-\.]{1,50}|linkedin\.com/in/[\w\-]{1,50}|github\.com/[\w\-]{1,50}|tiktok\.com/@[\w\-\.]{1,50}|youtube\.com/@[\w\-\.]{1,50})", r"@|\.com/"),
    Rule("phone", "電話", r"(?:\+81[\-\s]?\d{1,4}[\-\s]?\d{1,4}[\-\s]?\d{4}|0\d{1,4}[\-\s]\d{1,4}[\-\s]\d{4}|0[789]0[\-\s]\d{4}[\-\s]\d{4}|0120[\-\s]\d{3}[\-\s]\d{3})", r"\+81|0\d{1,4}[\-\s]"),
    Rule("patent", "特許", r"(?:特許|実用新案|意匠|商標)(?:登録)?第[\d,，]+号|(?:US|EP|JP|WO)\s*(?:Patent\s*)?[\d,，/]+(?:\s*[AB]\d?)?|特願\d{4}[-－]\d+|特開\d{4}[-－]\d+", "特許|実用新案|意匠|商標|US|EP|JP|WO|特願|特開", pre=r"^(?:(?:特許|実用新案|意匠|商標)(?:登録)?第|(?:US|EP|JP|WO)\s*(?:Patent\s*)?)", suf="号$"),
    Rule("serial", "シリアル", r"(?:S/?N|シリアル(?:番号)?|製造番号|SERIAL)[\s:：]?\s*[A-Z0-9\-]{4,24}|(?<![A-Z])[A-Z]{2,4}\d{6,12}(?![A-Z\d])", r"SN|S/N|シリアル|製造番号|SERIAL|[A-Z]{2}\d{6}"),
    Rule("model", "型番", r"(?:型番|型式|品番|モデル|Model|Part\s*No\.?|P/?N)[\s:：]?\s*[A-Z0-9][A-Z0-9\-－_/\.]{3,24}|(?<![A-Z\d])[A-Z]{1,5}[-－]\d{3,8}(?:[-－][A-Z0-9]{1,6})?(?![A-Z\d])", r"型番|型式|品番|モデル|Model|Part|PN|P/N|[A-Z][-－]\d{3}"),
    Rule("amount", "金額", r"(?:[¥￥]\s*)?(?<!\d)[\d,，]+(?:\.\d+)?(?=\s*(?:億|万|千)?円)", "円"),
    Rule("quantity", "数値", rf"(?<!\d)\d+(?:\.\d+)?(?=\s*(?:{_UNITS}))", rf"\d\s*(?:{_UNITS})"),
    Rule("period", "数値", r"(?<!\d)\d+(?=\s*(?:日間?|週間?|ヶ月間?|か月間?|カ月間?))", "[日週月]"),
    Rule("days", "数値", r"(?<!\d)\d+(?=\s*日(?!間|付|程|時|々|曜|数|照|野|産|米|系|本(?!社)))", "日"),
    Rule("age", "年齢", r"(?<!\d)\d{1,2}歳(?!\d)", "歳"),
)
# End of fixed values.


def java(pattern: str) -> str:
    """An equal pattern for Spark: digits, blanks and word characters as Python has them."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(r"\s\x1c-\x1f" if inside else r"[\s\x1c-\x1f]")
        elif two == r"\w":
            out.append(r"\p{L}\p{N}_" if inside else r"[\p{L}\p{N}_]")
        elif two == r"\W":
            out.append(r"&&[^\p{L}\p{N}_]" if inside else r"[^\p{L}\p{N}_]")
        elif two.startswith("\\") and len(two) == 2:
            out.append(two)
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
            continue
        i += 2
    return "(?U)" + "".join(out)


def gate(pattern: str) -> str:
    """java(pattern), without a flag where it has no class that needs one."""
    return java(pattern) if "\\" in pattern else pattern


def gate_for(pattern: str, own: str | None = None) -> Gate:
    """The gate of a pattern: its own one, whose alternatives are tried where a text has the kinds of characters that they need, or else the strings of which a text with a match has one, if any are known."""
    if own is None:
        words = factors.factors(pattern)
        return Gate(factors.needs(pattern), ((frozenset(), words),))
    kinds: dict[frozenset[str], tuple[list[str], list[str]]] = {}
    for part in factors.alternatives(own):
        words, others = kinds.setdefault(factors.needs(part), ([], []))
        word = factors.literal(part)
        others.append(part) if word is None else words.append(word)
    either = [(k, tuple(words)) for k, (words, _) in kinds.items() if words] + [(k, gate("|".join(others))) for k, (_, others) in kinds.items() if others]
    return Gate(factors.needs(pattern), tuple(sorted(either, key=lambda x: isinstance(x[1], str))))


def gate_of(rule: Rule) -> Gate:
    return gate_for(rule.pattern, rule.gate)


def words_gate(words: tuple[str, ...]) -> Gate:
    """That of texts that hold any of some words."""
    latin, wide = (tuple(w for w in words if bool(factors.needs(re.escape(w)) & {"wide"}) is x) for x in (False, True))
    return Gate(frozenset(), tuple((frozenset({"wide"} if group is wide else ()), java(first_letters(group) + f"(?:{_any(group)})")) for group in (latin, wide) if group))


#: Between these characters no match of DATE_FORMS, of the names' patterns or of RULES can go on, and none looks beyond: after a full stop or comma that no form, place or word has a part of,
#: and before a blank between two small letters (what goes on after a blank is a digit, a capital, a sign or no ASCII character at all).
_AFTER_STOP, _BETWEEN_WORDS = "(?<=[。、])", r"(?<=[a-z;!?])(?=\s[a-z])"


def cuts(rules: tuple[Rule, ...] = RULES, custom: tuple[str, ...] = ()) -> str | None:
    """A pattern of the (empty) places where a text can be cut without changing what is found in its parts, for Spark; None if there is none that is sure for these rules and custom names."""
    if not set(rules) <= set(RULES) or any(re.search("[。、]", name) for name in custom):
        return None
    return _AFTER_STOP if any(re.search(r"\s", name) for name in custom) else f"{_AFTER_STOP}|{_BETWEEN_WORDS}"
