"""Scalar helpers over text and time (columns in, columns out)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that count as punctuation, and the markers of explicit content.
PUNCTUATION = ". , ! ? ; : - ( ) 。 ， ！ ？ ； ： — （ ） ' \" … 、 ～ ~".split(" ")
EXPLICIT = ("🅴", "[E]")
# Traditional characters and their simplified forms, one to one; a larger table is a parameter.
TRADITIONAL = "漢語簡體轉換這個時間愛國學習歡樂聽說讀寫電腦網絡開關門東車馬鳥魚龍風雲飛機場員圓廣長們為來對會點樣經驗發現問題應該頭髮後裡麼臺灣軟詞編導無與從眾畫師傳統華麗觀見親誰請謝讓過還進遠邊達運動義務爾萬醜專業叢絲兩嚴喪豐臨舉烏喬鄉書買亂爭虧亞產億僅倉儀價優傷倫偉側債傾償兒黨蘭興養獸內軍農決況凍淨涼減鳳憑擊劃劉則剛創別劇勸辦勝勞勢區醫協單賣衛卻廠廳歷壓縣參雙變葉號嚇嗎啟吳喚團園圍圖聖壞塊堅聲處備復"
SIMPLIFIED = "汉语简体转换这个时间爱国学习欢乐听说读写电脑网络开关门东车马鸟鱼龙风云飞机场员圆广长们为来对会点样经验发现问题应该头发后里么台湾软词编导无与从众画师传统华丽观见亲谁请谢让过还进远边达运动义务尔万丑专业丛丝两严丧丰临举乌乔乡书买乱争亏亚产亿仅仓仪价优伤伦伟侧债倾偿儿党兰兴养兽内军农决况冻净凉减凤凭击划刘则刚创别剧劝办胜劳势区医协单卖卫却厂厅历压县参双变叶号吓吗启吴唤团园围图圣坏块坚声处备复"
# Words whose simplified characters stand for another traditional one than usual.
WORDS = {"头发": "頭髮", "理发": "理髮", "皇后": "皇后", "太后": "太后", "王后": "王后", "万里": "萬里", "千里": "千里", "公里": "公里", "故里": "故里", "干杯": "乾杯", "饼干": "餅乾"}


#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(c: Column) -> Column:
    """Without white space, Unicode's included, at the ends."""
    return F.btrim(c, F.lit(WHITE))


def to_int(c: Column) -> Column:
    """A signed whole number of 32 bits, or null; blanks are not numbers."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("int"))


def timestamp(ms: Column) -> Column:
    """mm:ss.SSS; negative times are 0, minutes go on past 60."""
    t = F.greatest(ms.cast("int"), F.lit(0))
    return F.format_string("%02d:%02d.%03d", F.floor(t / 60000).cast("int"), F.floor(t % 60000 / 1000).cast("int"), t % 1000)


def is_number(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def strip_brackets(c: Column) -> Column:
    """Trimmed, without one pair of brackets of one width around it."""
    t = trim(c)
    paired = (t.startswith("(") & t.endswith(")") | t.startswith("（") & t.endswith("）")) & (F.char_length(t) > 1)
    return F.when(paired, F.substring(t, F.lit(2), F.char_length(t) - 2)).otherwise(t)


def single_spaces(c: Column) -> Column:
    """Runs of spaces as one."""
    return F.regexp_replace(c, " +", " ")


def chars(c: Column) -> Column:
    """Characters of a text; none of an empty one."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def _lcs_bits(x: Column, y: Column) -> Column:
    """Common subsequence of two lists of characters, the second of at most BITS: a row of the table is the bits of one
    number, and a character moves the whole row on by a few operations (carries of an addition do the comparison)."""
    one = F.lit(1).cast("long")
    power = lambda i: F.call_function("shiftleft", one, i)

    def places(ch: Column) -> Column:
        return F.aggregate(F.transform(y, lambda v, i: F.when(v == ch, power(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(v))

    def count(every: Column) -> Column:
        def step(row: Column, ch: Column) -> Column:
            return let(row.bitwiseAND(places(ch)), lambda u: (row + u).bitwiseOR(row - u).bitwiseAND(every))

        return F.aggregate(x, every, step, lambda row: F.bit_count(every - row).cast("int"))

    return let(power(F.size(y)) - one, count)


def _lcs_rows(x: Column, y: Column) -> Column:
    """Common subsequence of two lists of any length: two folds, the row before as state."""
    first = F.transform(F.sequence(F.lit(0), F.size(y)), lambda _: F.lit(0))

    def row(before: Column, ch: Column) -> Column:
        def cell(now: Column, j: Column) -> Column:
            up, left, diagonal = F.get(before, j), F.element_at(now, -1), F.get(before, j - 1)
            return F.concat(now, F.array(F.when(F.get(y, j - 1) == ch, diagonal + 1).otherwise(F.greatest(up, left))))

        return F.aggregate(F.sequence(F.lit(1), F.size(y)), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(x, first, row), -1)


#: Characters whose row of the table fits a number, with room for a carry.
BITS = 61


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    swap = F.char_length(a) < F.char_length(b)
    found = let(chars(F.when(swap, b).otherwise(a)), lambda x: let(chars(F.when(swap, a).otherwise(b)), lambda y: F.when(F.size(y) <= BITS, _lcs_bits(x, y)).otherwise(_lcs_rows(x, y))))
    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(found)


def similarity(a: Column, b: Column, case_sensitive: bool = True) -> Column:
    """Common subsequence as a percentage of the longer text; equal texts 100, else an empty one 0."""
    if not case_sensitive:
        a, b = F.lower(a), F.lower(b)
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a == b, F.lit(100.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(lcs_length(a, b) / longer * 100)


def equal_positions(a: Column, b: Column) -> Column:
    """How many characters are the same at the same place."""
    return F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda same: same))


def clock_ms(c: Column) -> Column:
    """Milliseconds of ``SS.sss``, ``MM:SS.sss`` or ``HH:MM:SS.sss`` with an optional s; more parts read as a decimal."""
    v = F.regexp_replace(trim(c), "[sS]$", "")
    p = F.split(v, ":")
    part = [F.get(p, F.lit(i)).try_cast("double") for i in range(3)]
    seconds = (
        F.when(F.size(p) == 1, part[0])
        .when(F.size(p) == 2, part[0] * 60 + part[1])
        .when(F.size(p) == 3, part[0] * 3600 + part[1] * 60 + part[2])
        .otherwise(F.replace(v, F.lit(":"), F.lit(".")).try_cast("double"))
    )
    return F.round(seconds * 1000).try_cast("int")


def one_line(c: Column) -> Column:
    return F.regexp_replace(c, "[\r\n]", "")


def normal_spaces(c: Column) -> Column:
    return F.regexp_replace(trim(c), r"(?U)\s+", " ")


def language_key(c: Column) -> Column:
    t = trim(c)
    return F.when(t == "", "und").when(F.lower(t).startswith("zh"), "zh").otherwise(t)


def is_punctuation(c: Column) -> Column:
    return c.isin(PUNCTUATION)


def between(c: Column, start: str, stop: str) -> Column:
    """What stands between the first ``start`` and the next ``stop``; null without both."""
    at = F.instr(c, start)
    rest = F.substring(c, at + len(start), F.char_length(c))
    to = F.instr(rest, stop)
    return F.when((at > 0) & (to > 0), F.substring(rest, F.lit(1), to - 1))


def is_explicit(c: Column) -> Column:
    return c.contains(EXPLICIT[0]) | c.contains(EXPLICIT[1])


def hex_bytes(c: Column) -> Column:
    """Bytes of an even number of hex digits, else null."""
    return F.when(c.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(c))


def read_script(path: str) -> tuple[tuple[str, str], dict[str, str]]:
    """Characters and words of a dictionary in the customary form: a line for each, key, tab, values parted by spaces."""
    with open(path, encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f if "\t" in line and not line.startswith("#")]
    pairs = [(k, v.split(" ")[0]) for k, v, *_ in rows]
    single = [(k, v) for k, v in pairs if len(k) == 1 and len(v) == 1]
    return ("".join(k for k, _ in single), "".join(v for _, v in single)), {k: v for k, v in pairs if len(k) > 1}


def _converted(c: Column, table: tuple[str, str], words: dict[str, str]) -> Column:
    """The longest word at each place by the dictionary, all other characters by the table."""
    plain = F.translate(c, *table)
    if not words:
        return plain
    any_word = "|".join(rf"\Q{k}\E" for k in sorted(words, key=lambda k: (-len(k), k)))
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    parts = F.regexp_extract_all(c, F.lit(f"(?s)({any_word}|.)"), F.lit(1))
    return F.when(c.rlike(any_word), F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(known, t), F.translate(t, *table))), "")).otherwise(plain)


def to_simplified(c: Column, table: tuple[str, str] = (TRADITIONAL, SIMPLIFIED), phrases: dict[str, str] | None = None) -> Column:
    """Simplified script: words of ``phrases`` first, then single characters; a larger dictionary comes by ``read_script``."""
    return _converted(c, table, phrases or {})


def to_traditional(c: Column, table: tuple[str, str] = (TRADITIONAL, SIMPLIFIED), phrases: dict[str, str] = WORDS) -> Column:
    """Traditional script; ``table`` has the traditional characters first, the usual one of several before the others."""
    pairs = dict(zip(reversed(table[1]), reversed(table[0]), strict=True))
    return _converted(c, ("".join(pairs), "".join(pairs.values())), phrases)


def min_opt(a: Column, b: Column) -> Column:
    """The smaller; of one missing, the other."""
    return F.least(a, b)


def max_opt(a: Column, b: Column) -> Column:
    return F.greatest(a, b)
