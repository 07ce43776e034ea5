"""Sentence boundaries across languages and scripts, in plain Python for use in Arrow batches.

A text is first cut into blocks: fenced code, headings, table rows, list items and paragraphs. Running text is then cut
at gaps. Text inside one pair of quotation marks or brackets is closed to gaps; what closes behind a terminator belongs
to the unit.

* Scripts without spaces: at a gap (terminator, line break, wide or Thai space, dots, closing mark) the run of signs
  before and the run behind are segmented by the cheapest path through a dictionary word lattice; final particles and
  closing words speak for an end, particles that govern what follows and continuing opening words against it.
* Scripts with spaces: the terminators of a paragraph form a lattice, each with the readings "ends a sentence" and
  "stands inside" (abbreviation, ordinal, initial, dots); the cheapest path through the readings is taken, where an
  end that leaves no word in a unit is not allowed and units of one word cost a little, more after an abbreviation that a
  single word may follow.

Every text is read once from left to right. At a gap the whole runs of spaceless signs around it are segmented, and in
spaced scripts the words around it are looked up, so time is linear in the text's length.
"""

from __future__ import annotations

import re
from functools import lru_cache

# --- blocks -----------------------------------------------------------------------------------------------------------
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_HEAD = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_FENCE = re.compile(r"[ \t]{0,3}(```+|~~~+)")
_ROW = re.compile(r"[ \t]*\|.*\|[ \t]*$")
_BULLET = re.compile(r"[ \t]*(?:[-*+•◦▪‣·●○■□☐☑☒✓✔–—]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)](?=[ \t])|[（(](?:\d{1,3}|[一二三四五六七八九十]{1,3})[）)]|[①-⑳]|[一二三四五六七八九十]{1,3}、)(?:[ \t　]+|(?<=[、）①-⑳]))(?:\[[ xX]\][ \t]+)?")
_NUMBERED = re.compile(r"[ \t]*\(?(?:\d|[A-Za-z][.)])")

# --- marks ------------------------------------------------------------------------------------------------------------
TERMINATORS = ".!?…。！？．｡؟।॥۔"
_CLOSERS = "\"'”’»«“」』）)]】》〉›*_`"
_TOKEN = re.compile(r"(?P<end>(?:[!?…。！？．｡؟।॥۔]|\.{2,}|\.(?=[\s\"'”’»«“)\]）」』*_`]|$|[぀-ヿ㐀-鿿])|(?<=[぀-ヿ㐀-鿿])\.|\.(?=[A-ZÀ-Þ][a-zß-ÿ]* [a-zß-ÿ])|(?<=[.](?:py|js|ts|md|go))\.(?=\w)|(?<=[.](?:vue|yml|sql|xml|cpp))\.(?=\w)|(?<=[.](?:java|json|html|yaml|toml))\.(?=\w))[!?…。！？．｡.]*)|(?P<mark>[\"“”„«»‹›「」『』（）()\[\]【】《》〈〉〔〕])|(?P<wide>[　])|(?P<line>[ \t]*(?:\r\n|\r|\n)[ \t]*)|(?P<thai>(?<=\S) +(?=\S))")
_OPEN = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "〔": "〕"}
_CLOSE = {c: o for o, c in _OPEN.items()}
_SPACELESS = re.compile(r"[぀-ヿ㐀-䶿一-鿿\uf900-\ufaff฀-๿]")
_HAN = re.compile(r"[぀-ヿ㐀-䶿一-鿿\uf900-\ufaff]")
_THAI = re.compile(r"[฀-๿]")

# --- spaceless scripts: dictionary, particles, openings ---------------------------------------------------------------
#: Words that go on with the sentence before them (Chinese, Japanese, Thai).
CONTINUING = (
    "然后 随后 接着 之后 以后 而后 并 并且 而且 但 但是 却 而 也 就 便 才 再 又 还 或 或者 以及 及 和 与 的 了 所以 因此 因为 于是 不过 可是 只是 从而 以便 以免 则 即 被 把 是 说 写道 问 问道 "
    "と という といった とある が は を に へ で の も や から まで より ので のに けれど けど ば なら たり って もう まだ ても など だけ しか さえ です だ でした である "
    "และ แล้ว จากนั้น หรือ แต่ เพราะ ที่ ซึ่ง โดย ของ ใน ให้ ว่า อยู่ ได้ ด้วย เหลือ ยังใช้ ใช้เวลา พบปัญหา สองครั้ง ครั้ง ตั้งแต่ รายการ วินาที นาที ไฟล์ บาท คน จึง ก็ เป็น ถึง เท่านั้น ต่อ จาก กับ จะ มี ไม่ได้ ขึ้น ลง"
).split()
#: Words that open a sentence (Thai sentences are parted by a space alone).
OPENING = (
    "就目前 就算 就此 就在 再者 再说 再次 还有 也许 与其 与此同时 和平 是否 说明 即使 便利 又一次 把握 被动 "
    "ถ้า หาก เมื่อ ไม่มี ยังไม่มี การ เรา ตัวเลข หลังจาก หลัง ก่อน โปรด กรุณา กฎ รุ่น ผู้ คะแนน ตัว ทีม ระบบ ผม ฉัน เขา พวกเขา ปัญหา ความ ใคร ทำไม อย่า จง ทุก บาง แม้ ดังนั้น นอกจาก ข้อ คำ งาน บริการ หยุด ควร ต้อง ขณะ ตอน วันนี้ ปัจจุบัน สรุป"
).split()
#: Particles and words that close a sentence.
FINAL = "了 吗 呢 吧 啊 嘛 呀 的 过 着 です ます ました ません ください でした だ だった た ない か よ ね い る ครับ ค่ะ คะ นะ แล้ว ก่อน อยู่ ด้วย ซ้ำ ได้ กัน ไหม หรือไม่".split()
#: Particles that govern what follows; no sentence ends with one.
GOVERNING = "は が を に へ で と も の や から より ので のに ば ながら て 把 被 由 在 对 向 从 为 给 让 使 和 与 跟 及 或 但 而 并 且 因为 如果 虽然 由于 以及 ที่ และ ของ ใน โดย ว่า เพราะ หรือ แต่ ซึ่ง".split()

_WORDS = {w: 1.0 for group in (CONTINUING, OPENING, FINAL, GOVERNING) for w in group}
_LONGEST = max(map(len, _WORDS))
#: The run of spaceless signs at the end and at the start of a text.
_LAST_RUN, _FIRST_RUN = re.compile(r"[぀-ヿ㐀-䶿一-鿿\uf900-\ufaff฀-๿]+\Z"), re.compile(r"[぀-ヿ㐀-䶿一-鿿\uf900-\ufaff฀-๿]+")


@lru_cache(maxsize=200_000)
def lattice(signs: str) -> tuple[str, ...]:
    """The cheapest path through the lattice of dictionary words and single unknown signs."""
    n = len(signs)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(1e9, 0)] * n
    for i in range(n):
        here = best[i][0]
        for k in range(1, min(_LONGEST, n - i) + 1):
            word = signs[i : i + k]
            cost = _WORDS.get(word)
            if cost is None:
                if k > 1:
                    continue
                cost = 1.6
            if here + cost < best[i + k][0]:
                best[i + k] = (here + cost, i)
    out, i = [], n
    while i:
        j = best[i][1]
        out.append(signs[j:i])
        i = j
    return tuple(reversed(out))


_CONT, _OPENING, _FINAL, _GOV = set(CONTINUING), set(OPENING), set(FINAL), set(GOVERNING)


def _first_word(after: str, group: set[str]) -> bool:
    """Whether the text opens with a word of the group: the lattice's first word, or the longest dictionary word there."""
    if not after:
        return False
    run = _FIRST_RUN.match(after)
    path = lattice(run.group()) if run else ()
    if path and path[0] in group:
        return True
    for k in range(min(_LONGEST, len(after)), 1, -1):
        w = after[:k]
        if w in _WORDS:
            return w in group
    return False


def spaceless_gap(before: str, after: str, kind: str) -> bool:
    """Whether a sentence of a script without spaces ends at a gap of this kind (line, wide, thai, dots, close)."""
    after = after.lstrip()
    if not after:
        return True
    tail = before.rstrip()
    if after[0] in "，、；：,;:。！？．)）」』”’》】〉" or tail[-1:] in "，、；：,;:（(「『“《【":
        return False
    run = _LAST_RUN.search(tail)
    last = lattice(run.group())[-1] if run else tail[-1:]
    if kind in ("dots", "line", "wide") and last in _GOV and not (last in _FINAL and kind != "dots"):
        return False
    if kind == "thai":
        if not _THAI.match(after[0]) or not tail:
            return False
        if _first_word(after, _OPENING):
            return True
        return bool(_THAI.match(tail[-1])) and not _first_word(after, _CONT)
    if kind == "close" and re.match(r"[぀-ゟ]", after[0]):
        return not _first_word(after, _CONT) and after[:1] not in "とがはをにのでもへや"
    if kind in ("dots", "close"):
        return not _first_word(after, _CONT)
    return True


# --- scripts with spaces ----------------------------------------------------------------------------------------------
#: Abbreviations that never end a sentence (lower case, without the last point).
INNER = set(
    "e.g i.e cf vs viz approx incl excl esp resp no nos nr fig figs sec secs dept eq eqs ref refs app tab tabs vol vols ch chap art arts para paras p pp ver rev ed eds est min max avg dr mr mrs ms prof st mt gen col sgt capt rep sen gov hon jr sr a.k.a aka ca circa jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri "
    "z b z.b d d.h h u a u.a bzw ggf ggü inkl exkl evtl insb insbes abs abb kap bd s vgl sog zzgl gem lt str tel geb hrsg jg mio mrd usf bspw "
    "ex p.ex c.-à-d réf env éd av m mm mme mlle "
    "núm num pág págs ej p.ej aprox cap sr sra srta ud uds dra lic av dpto "
    "т е т.е н п рис табл стр гл см напр им ул руб тыс млн млрд ред "
    "ص د أ م".split()
)
#: Abbreviations that may also end one.
BOTH = set("etc &c al a.m p.m am pm u.s u.k u.n e.u inc ltd co corp usw ff f т.д т.п др пр u.ä".split())
#: Of these, the ones after which a lone word goes on ("at 5 p.m. Monday.", "the U.S. Congress.").
LOOSE = set("am pm a.m p.m u.s u.k u.n e.u inc ltd co corp".split())
MONTHS = set(
    "januar februar märz april mai juni juli august september oktober november dezember jänner january february march may june july october december januari janvier février mars avril juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
)
#: Words that go on after a closing mark in scripts without letter case (Arabic, Hindi, Korean).
GOES_ON = set("ثم و ف حيث لأن ولكن لكن أو قال وقال وأغلق فأغلق और पर तो कि फिर लेकिन या ने को में से के की का कहा लिखा पूछा बोला 라고 이라고 하고 라는 고 그리고 라며 는 은 이 가 을 를".split())
_PREV = re.compile(r"[^\s\"“”„«»()\[\]（）「」『』，、。：；]+$")
_NEXT = re.compile(r"[\s\"'“”„«»‹›(\[（「『¿¡*_`]*([^\s\"“”„«»)\]]+)")
_IDENT = re.compile(r"[\w.\-]*[/\\_][\w./\\\-]+|[a-z]+(?:[A-Z]\w*)+|\w+\(\)|\w+\.\w{1,4}\b|`")
#: Abbreviations of several parts that may end a sentence.
_MAY_END = re.compile(r"(?:\bт\.\s*[дп]|\bи\s+(?:др|пр)|\bu\.\s*v\.\s*[am]|\b[uo]\.\s*ä)$", re.I)
_COSTLY = 50.0
#: Costs of an abbreviation that may end a sentence before a capital: the terminator alone speaks for an end. The path turns
#: it where the unit that would begin there ends with its first word.
AMBIGUOUS, LONE_WORD, LONE_AFTER_LOOSE = (0.5, 1.5), 0.4, 1.2


def readings(before: str, mark: str, after: str, closed: bool) -> tuple[float, float]:
    """Costs of "ends here" and "stands inside" for one terminator of a script with spaces."""
    found = _NEXT.match(after)
    if not found:
        return 0.0, 4.0
    nxt = found.group(1)
    opens = after[: found.start(1)]
    first = nxt[0]
    if first in ",;:،؛，；：" or first in TERMINATORS and not nxt.strip(TERMINATORS):
        return _COSTLY, 0.0
    lower = first.islower() and not _IDENT.match(nxt)
    caseless = first.isalpha() and not first.islower() and not first.isupper()
    dash = first in "-–—" and len(nxt) == 1
    if lower or dash:
        # A small letter goes on with the sentence; only a full stop that nothing else explains could end one.
        return 8.0, 0.0
    if closed and caseless and (nxt.rstrip(".,") in GOES_ON or nxt[:1] in "وف" and len(nxt) > 3 and nxt[1:3] != "ال" and nxt[1:] in GOES_ON):
        return 8.0, 0.0
    if mark[0] != "." or len(mark) > 1:
        return 0.0, 3.0
    if closed:
        return 0.0, 3.0
    prev = _PREV.search(before)
    word = prev.group().lower().lstrip("('’") if prev else ""
    bare = word.rsplit("'", 1)[-1].rsplit("’", 1)[-1]
    if word in BOTH or bare in BOTH or _MAY_END.search(before):
        return AMBIGUOUS if first.isupper() or caseless or _IDENT.match(nxt) or opens.strip() else (6.0, 0.0)
    if word in INNER or bare in INNER:
        return 6.0, 0.0
    if len(bare) == 1 and bare.isalpha() and not (_HAN.match(bare) or _THAI.match(bare)):
        return 5.0, 0.0
    if bare.isdigit() and len(bare) <= 2 and nxt.rstrip(".,;:)").lower() in MONTHS:
        return 6.0, 0.0
    return 0.0, 3.0


def _unspaced(before: str, mark: str) -> bool:
    """Whether a terminator without a space behind it can end: a plain word before it, no abbreviation."""
    word = re.split(r"\s", before)[-1].lower()
    return mark[0] in "!?" or word not in INNER and word not in BOTH


def cheapest(costs: list[tuple[float, float]], words: list[bool], more: list[float]) -> list[bool]:
    """Path through the readings: ``words[i]`` tells whether a word stands between terminators i-1 and i, ``more[i]`` is
    added where both i-1 and i end."""
    if not costs:
        return []
    ends, inside = costs[0]
    back: list[tuple[bool, bool]] = []
    for i in range(1, len(costs)):
        e, s = costs[i]
        after_end = ends + e + (_COSTLY if not words[i] else more[i])
        after_inside = inside + e
        back.append((after_end <= after_inside, ends <= inside))
        ends, inside = min(after_end, after_inside), min(ends, inside) + s
    out = [ends <= inside]
    for by_end, by_inside in reversed(back):
        out.append(by_end if out[-1] else by_inside)
    return out[::-1]


# --- running text -----------------------------------------------------------------------------------------------------
def _pairs(text: str, marks: list[re.Match]) -> list[tuple[int, int]]:
    """Outermost pairs of quotation marks and brackets; what never closes opens nothing. Open marks are counted by kind,
    so a mark without an opener looks at none of them, and one with an opener drops what was opened behind it: linear."""
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    found: list[tuple[int, int]] = []
    first = next((m.group() for m in marks if m.group() in "«»„"), "")
    reversed_angles = first == "»"
    low = any(m.group() == "„" for m in marks)
    for m in marks:
        c, at = m.group(), m.start()
        if c == '"':
            opens, partner = not count.get('"'), '"'
        elif c in "«»" and reversed_angles:
            opens, partner = c == "»", "»"
        elif c == "“" and low and count.get("„"):
            opens, partner = False, "„"
        elif c in _OPEN:
            opens, partner = True, c
        else:
            opens, partner = False, _CLOSE.get(c, "")
            if c == "”" and low and not count.get("“"):
                partner = "„"
        if opens:
            stack.append((c, at))
            count[c] = count.get(c, 0) + 1
        elif count.get(partner):
            while True:
                mark, place = stack.pop()
                count[mark] -= 1
                if mark == partner:
                    found.append((place, at))
                    break
    return sorted(found)


#: No listed word or abbreviation is half as long, so a word's part within so many signs is in the same lists as the word.
WORD = 48
#: A line break is one of a spaceless script if such a sign stands among so many before or behind it; a wide space, which
#: other scripts seldom have, if one stands among WORD.
NEAR = 8


def _back(text: str, at: int, least: int) -> int:
    """The start of the last WORD signs before ``at``, white space and closing marks not counted."""
    while at > least and (text[at - 1].isspace() or text[at - 1] in _CLOSERS):
        at -= 1
    return max(at - WORD, least)


def _run_start(text: str, at: int) -> int:
    """Where the run of spaceless signs that ends at ``at`` starts, or WORD signs before if that is more."""
    start = max(at - WORD, 0)
    while start and _FIRST_RUN.fullmatch(text, start, at):
        at, start = start, max(start - WORD, 0)
    return start


def _run_stop(text: str, at: int) -> int:
    run = _FIRST_RUN.match(text, at)
    return max(run.end() if run else at, min(at + WORD, len(text)))


def running(text: str, start: int, stop: int, out: list[int]) -> None:
    """Appends the ends of the sentence units of running text ``text[start:stop]``."""
    while stop > start and text[stop - 1].isspace():
        stop -= 1
    while start < stop and text[start].isspace():
        start += 1
    if start >= stop:
        return
    piece = text[start:stop]
    tokens = list(_TOKEN.finditer(piece))
    spans: list[tuple[int, int]] = []
    high = -1
    for a, b in _pairs(piece, [m for m in tokens if m.lastgroup == "mark"]):
        if a > high:
            spans.append((a, b))
            high = b
    has_thai = bool(_THAI.search(piece))
    gaps: list[tuple[int, float, float]] = []  # end, cost of ending, cost of going on
    s, n = 0, len(piece)
    for m in tokens:
        a = m.start()
        while s < len(spans) and spans[s][1] < a:
            s += 1
        kind = m.lastgroup
        if s < len(spans) and spans[s][0] <= a:
            if kind != "mark" or a != spans[s][1]:
                continue
            # The mark that closes an outermost pair: a gap if a terminator stands right inside it.
            inner = piece[_back(piece, a, spans[s][0]) : a].rstrip()
            if not inner or inner[-1] not in TERMINATORS and not (inner[-1] in _CLOSERS and inner[:-1].rstrip(_CLOSERS)[-1:] in TERMINATORS and inner[:-1]):
                continue
            mark, at, closed = inner[-1], a + 1, True
            before = inner[:-1]
        elif kind == "end":
            mark, at, closed, before = m.group(), m.end(), False, piece[max(0, a - WORD) : a]
        elif kind in ("wide", "line", "thai"):
            if kind == "thai" and not has_thai:
                continue
            left, right = piece[_run_start(piece, a) : a], piece[m.end() : _run_stop(piece, m.end())]
            near = NEAR if kind == "line" else WORD
            if kind in ("line", "wide") and not (_SPACELESS.search(left[-near:]) or _SPACELESS.search(right[:near])):
                continue
            if left.rstrip()[-1:] in TERMINATORS + _CLOSERS and left.rstrip()[-1:] != "":
                if left.rstrip()[-1:] in TERMINATORS:
                    continue
            if kind == "thai":
                double = m.end() - a >= 2
                ends = double or spaceless_gap(left, right, "thai")
            elif kind == "line" and has_thai and _THAI.search(left + right):
                ends = _first_word(right.lstrip(), _OPENING) or spaceless_gap(left, right, "line")
            else:
                ends = spaceless_gap(left, right, kind)
            if ends and left.strip():
                gaps.append((a, 0.0, 3.0))
            continue
        else:
            continue
        # Marks that close behind the terminator belong to the unit.
        while at < n and piece[at] in "\"'”’»「」』）)]】》〉›*_`“«":
            c = piece[at]
            if c in '"“«' and (at + 1 >= n or not piece[at + 1].isspace()) or c in "「":
                break
            if c in '"“«»' and s < len(spans) and spans[s][0] == at:
                break
            at += 1
        if at < n and piece[at] in "。！？!?．…." and closed:
            continue  # the terminator behind the mark decides
        word = at
        while word < n and piece[word].isspace():
            word += 1
        rest = piece[at : max(word + WORD, _run_stop(piece, word))]
        if word == n:
            gaps.append((at, 0.0, _COSTLY))
            continue
        spaced = rest[0].isspace()
        body = rest.lstrip()
        left_sign = before.rstrip(_CLOSERS + " ")[-1:]
        foreign = mark[0] in "。！？．｡" or bool(_SPACELESS.match(body[0])) or bool(left_sign and _SPACELESS.match(left_sign))
        if foreign and mark[0] != "." or foreign and mark[0] == "." and len(mark) == 1 and not spaced:
            if mark[0] == "…" or mark.startswith(".."):
                ends = spaceless_gap(before, rest, "dots")
            elif closed or piece[at - 1] in "”’」』）)]】》〉\"":
                ends = spaceless_gap(before, rest, "close")
            else:
                ends = body[0] not in "，、；：,;:"
            gaps.append((at, *((0.0, 3.0) if ends else (_COSTLY, 0.0))))
            continue
        if mark.startswith("..") and foreign:
            ends = spaceless_gap(before, rest, "dots")
            gaps.append((at, *((0.0, 3.0) if ends else (_COSTLY, 0.0))))
            continue
        if not spaced:
            if mark[0] in "。！？．｡" or mark == "." and re.search(r"\.\w{2,4}$", before) or rest[0].isupper() and not closed and re.search(r"(?:^|\s)[^\W\d_]{2,}$", before) and _unspaced(before, mark):
                gaps.append((at, 0.0, 3.0))
            continue
        gaps.append((at, *readings(before, mark, rest, closed)))
    if gaps:
        gaps.sort()
        words, more, last, loose = [], [], 0, False
        for at, end_cost, inside_cost in gaps:
            part = piece[last:at]
            words.append(any(c.isalnum() for c in part))
            lone = len(part.split()) <= 1 and not _SPACELESS.search(part)
            more.append((LONE_AFTER_LOOSE if loose and part.endswith(".") else LONE_WORD) if lone else 0.0)
            before = _PREV.search(piece[max(0, at - 1 - WORD) : at].rstrip(".")) if (end_cost, inside_cost) == AMBIGUOUS else None
            last, loose = at, bool(before and before.group().lower() in LOOSE)
        base = start
        for (at, _, _), ends in zip(gaps, cheapest([(e, g) for _, e, g in gaps], words, more), strict=True):
            if ends and 0 < at < n:
                end = base + at
                if not out or out[-1] < end:
                    out.append(end)
    if not out or out[-1] < stop:
        out.append(stop)


def ends(text: str | None) -> list[int]:
    """Ends of all sentence units: code points before and including the last character."""
    out: list[int] = []
    if not text or text.isspace():
        return out
    fence = ""
    fence_end = 0
    para: list[int] = []  # start and stop of the paragraph that is open
    in_list = False

    def flush() -> None:
        if para:
            running(text, para[0], para[1], out)
            para.clear()

    for m in _LINE.finditer(text):
        a, b = m.start(), m.end()
        if a == b:
            break
        line = m.group().rstrip("\r\n")
        stop = a + len(line.rstrip())
        if fence:
            fence_end = max(fence_end, stop)
            mark = _FENCE.match(line)
            if mark and line.strip().startswith(fence) and not line.strip().strip("`~"):
                out.append(stop)
                fence = ""
            continue
        if stop == a:
            flush()
            in_list = False
            continue
        mark = _FENCE.match(line)
        if mark:
            flush()
            in_list = False
            if len(line.strip()) > 6 and line.strip().endswith("```"):
                out.append(stop)
            else:
                fence, fence_end = mark.group(1), stop
            continue
        if _HEAD.match(line):
            flush()
            in_list = False
            out.append(stop)
            continue
        if _ROW.match(line):
            flush()
            in_list = False
            out.append(stop)
            continue
        bullet = _BULLET.match(line)
        if bullet and bullet.end() < len(line.rstrip()) and (not para or in_list or not _NUMBERED.match(line)):
            flush()
            in_list = True
            para[:] = [a + bullet.end(), stop]
            continue
        if para:
            para[1] = stop
        else:
            para[:] = [a, stop]
    if fence:
        out.append(fence_end)
    flush()
    return out
