"""Line and word shape of one text, in plain Python for use in Arrow batches: what text types are told from."""

from __future__ import annotations

import re
from collections import Counter

from tallyloom.llm.languages import _WORDS

HEADING = re.compile(r"^\s{0,3}#{1,6}\s+\S")
FENCE = re.compile(r"^\s{0,3}(```+|~~~+)")
#: A list marker at the start of a line: bullets, boxes, numbers, letters.
MARKER = re.compile(r"^\s*(?:[-*+•◦▪‣·●○■□☐☑☒✓✔✗–—]\s+(?:\[[ xX]\]\s*)?|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)、]\s*(?=\S)|[（(](?:\d{1,3}|[一二三四五六七八九十]+|[a-zA-Z])[)）]\s*|[①-⑳]\s*|[一二三四五六七八九十]{1,3}、\s*|第[一二三四五六七八九十\d]+[、：]\s*)")
PAIR = re.compile(r"^\s*[\"'`]?[^:：=\t|]{1,40}?[\"'`]?\s*(?:[:：=]|->|=>|→)\s*\S.{0,60}$")
INNER_END = re.compile(r"[a-zà-ÿ)\]\"”»][.!?]\s+[A-ZÀ-Þ¿¡«\"“(]|[。！？]|[।؟]\s")
RULE_LINE = re.compile(r"^[\s|+:=\-─━┼├┤│┌┐└┘┬┴╋═]*[-─━=]{3,}[\s|+:=\-─━┼├┤│┌┐└┘┬┴╋═]*$")
_SPLITS = (
    ("box", re.compile(r"\s*[│┃║]\s*")),
    ("pipe", re.compile(r"\s*\|\s*")),
    ("tab", re.compile(r"\t+")),
    ("semicolon", re.compile(r";")),
    ("comma", re.compile(r",")),
    ("space", re.compile(r"\s{2,}")),
)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", re.UNICODE)
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿\uf900-\ufaff฀-๿]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|&[a-z]{2,8};|&#\d+;")
_HEX = re.compile(r"^(?:0x)?(?=.*\d|[a-f]{2}$)[0-9a-fA-F]{2,16}:?$")
_LONG_CODE = re.compile(r"[A-Za-z0-9+/=_\-]{40,}")
_BROKEN = re.compile("[�\x80-\x9f]|[ÃÂâäåæçèéð][\x80-\xbf‐-⃿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¡-¿]|(?:锟斤拷)|(?:烫){2,}|(?:屯){2,}|[ÐÑØÙ][-¿]")
_VOWELS = frozenset("aeiouyAEIOUY")
_HEX_SIGNS = frozenset("0123456789abcdefABCDEFx:")
_SENTENCE_END = re.compile(r"[.!?](?=[\"'”’»)\]]*(?:\s|$))|[。！？।؟…]")
#: Signs that nearly every running text of the spaceless scripts holds.
CJK_COMMON = set("的了是在不有和这我们也就都要会对到说以为被把从没还里中上下个之与及のにはをがとでもてすまたしるだいれ")
#: Particles and endings that close most Korean words.
HANGUL_COMMON = tuple("은는이가을를에의로고도다서면지과와만까") + ("니다", "에서", "으로", "하는", "부터")
THAI_COMMON = ("ที่", "และ", "ใน", "ไม่", "ของ", "เป็น", "ให้", "ได้", "การ", "เรา", "แล้ว")


def visible(text: str) -> int:
    return sum(map(len, text.split()))


_CLOSING = "\"'”’」』»）)]*_"
_TERMINATORS = frozenset(".!?。！？।؟…")


def has_end(line: str) -> bool:
    """Whether a line ends in a terminator, but for the marks that close behind it."""
    return line.rstrip().rstrip(_CLOSING)[-1:] in _TERMINATORS and bool(line.strip())


def _short_item(content: str) -> bool:
    """A name or an item rather than a sentence."""
    content = content.strip()
    if not content or has_end(content) and not content.endswith(("...", "…")) or INNER_END.search(content):
        return False
    cjk = 0 if content.isascii() else len(_CJK.findall(content))
    if cjk > 4:
        return cjk <= 22 and not re.search(r"[，、；]", content)
    words = content.split()
    if len(words) > 8:
        return False
    function = sum(w.lower().strip(",;:") in _WORDS for w in words)
    return len(words) <= 3 or function <= 0.34 * len(words)


def _rows(lines: list[str]) -> tuple[set[int], str]:
    """Numbers of the lines that are rows of cells under one delimiter, and the delimiter."""
    best: tuple[set[int], str] = (set(), "")
    ended = [has_end(line) for line in lines]
    for name, pattern in _SPLITS:
        counts: dict[int, int] = {}
        listed = name in ("semicolon", "comma")
        for i, line in enumerate(lines):
            s = line.strip()
            if listed and ended[i] or not pattern.search(s):
                continue
            if name in ("pipe", "box"):
                s = s.strip("|│┃║ ")
            cells = pattern.split(s)
            if listed and (any(len(c.split()) > 3 or len(c) > 32 or not c.strip() for c in cells) or len(cells) < 4 and re.search(r"[,;]\s", s)):
                continue
            if name == "space" and (any(len(c) > 40 for c in cells) or MARKER.match(line)):
                continue
            if len(cells) >= 2:
                counts[i] = len(cells)
        if not counts:
            continue
        width, most = Counter(counts.values()).most_common(1)[0]
        rows = {i for i, n in counts.items() if n == width or name in ("pipe", "box") and n >= 2}
        if most >= 3 or name in ("pipe", "box") and len(rows) >= 2:
            rows |= {i for i, line in enumerate(lines) if RULE_LINE.match(line)}
            if len(rows) > len(best[0]):
                best = (rows, name)
    return best


#: Markdown emphasis and thematic breaks: no symbols of the text.
_EMPHASIS = re.compile(r"[*_]{2,}|^\s*[-*_=]{3,}\s*$", re.M)


class _Kinds(dict):
    """Character -> its kind, found once: at most one entry for each code point."""

    def __missing__(self, c: str) -> str:
        kind = "space" if c.isspace() else "symbol" if not c.isalnum() else "digit" if c.isdigit() else "cjk" if _CJK.match(c) else "letter"
        self[c] = kind
        return kind


_KINDS = _Kinds()


def _is_name(token: str) -> bool:
    """A path or a name with underscores: its parts are no words of a language."""
    return "/" in token or "_" in token or "\\" in token


def body_lines(text: str) -> tuple[list[str], int]:
    """The lines that are neither blank nor headings nor fenced code, and the visible characters of the fenced code."""
    body: list[str] = []
    code = 0
    fence = ""
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        first = line.lstrip()[:1]
        mark = FENCE.match(line) if first in ("`", "~") else None
        if fence:
            code += visible(line)
            if mark and mark.group(1)[:3] == fence:
                fence = ""
        elif mark:
            fence = mark.group(1)[:3]
            code += visible(line)
        elif first and not (first == "#" and HEADING.match(line)):
            body.append(line)
    return body, code


def _is_common(word: str) -> bool:
    return word in _WORDS or "가" <= word[-1] <= "힣" and word.endswith(HANGUL_COMMON)


def _is_entry(line: str, ended: bool, mark: re.Match | None) -> bool:
    if ended and not line.rstrip().endswith(("...", "…")):
        return False
    if mark:
        return _short_item(line[mark.end() :])
    return _short_item(line) or not ended and bool(PAIR.match(line)) and not INNER_END.search(line)


def shape(text: str) -> dict:
    """Counts and shares of one text; every share is 0 for a text without visible characters.

    Characters are counted once (a text has few distinct ones) and told apart by their kinds. The share of common words is
    over distinct words, so one that is said over and over counts once.
    """
    body, code = body_lines(text)
    plain = "\n".join(body)
    chars = Counter(plain)
    kinds = dict.fromkeys(("space", "symbol", "digit", "cjk", "letter"), 0)
    for c, n in chars.items():
        kinds[_KINDS[c]] += n
    seen, symbols, digits, cjk = len(plain) - kinds["space"], kinds["symbol"], kinds["digit"], kinds["cjk"]
    if symbols and (chars["*"] or chars["_"] or chars["-"] or chars["="]):
        symbols -= sum(len(m.strip()) for m in _EMPHASIS.findall(plain))
    common_cjk = sum(chars[c] for c in CJK_COMMON) if cjk else 0
    if cjk and any("\u0e00" <= c <= "\u0e7f" for c in chars):
        common_cjk += sum(plain.count(t) * 2 for t in THAI_COMMON)
    words = _WORD.findall(plain)
    latin = [w for w in words if not _CJK.search(w)] if cjk else words
    tokens = plain.split()
    own = {w for w in _WORD.findall(" ".join(t for t in tokens if not _is_name(t)).lower()) if not (cjk and _CJK.search(w))}
    rows, delimiter = _rows(body) if len(body) >= 2 else (set(), "")
    entry_chars = entries = marked = ended = row_chars = 0
    for i, line in enumerate(body):
        mark, closed = MARKER.match(line), has_end(line)
        marked += bool(mark)
        ended += closed
        entry = _is_entry(line, closed, mark)
        if entry or i in rows:
            size = visible(line)
            entries += entry
            entry_chars += size if entry else 0
            row_chars += size if i in rows else 0
    tags = sum(map(len, _TAG.findall(plain))) if chars["<"] or chars["&"] else 0
    hexes = sum(len(t) for t in tokens if len(t) < 20 and _HEX_SIGNS.issuperset(t) and _HEX.match(t)) if digits else 0
    long_code = sum(len(t) for t in _LONG_CODE.findall(plain) if len(t) > 60 or re.search(r"\d", t)) if max(map(len, tokens), default=0) >= 40 else 0
    broken = 0 if plain.isascii() else sum(map(len, _BROKEN.findall(plain)))
    hard = [w for w in latin if len(w) >= 2 and w.isascii()]
    vowelless = sum(map(_VOWELS.isdisjoint, hard)) if len(hard) >= 8 else 0
    sentences = len(_SENTENCE_END.findall(plain))
    one = max(seen, 1)
    return {
        "chars": len(text),
        "seen": seen,
        "code_share": code / max(seen + code, 1),
        "lines": len(body),
        "words": len(words),
        "mean_word": sum(map(len, latin)) / max(len(latin), 1),
        "symbol_share": symbols / one,
        "digit_share": digits / one,
        "tag_share": tags / one,
        "hex_share": hexes / one,
        "long_code_share": long_code / one,
        "broken_share": broken / one,
        "vowelless_share": vowelless / max(len(hard), 1),
        "common_share": sum(map(_is_common, own)) / max(len(own), 1),
        "common_cjk_share": common_cjk / max(cjk, 1),
        "cjk": cjk,
        "latin": len(latin),
        "entry_share": entry_chars / one,
        "row_share": row_chars / one,
        "rows": len(rows),
        "entries": entries,
        "delimiter": delimiter,
        "marked": marked,
        "ended_share": ended / max(len(body), 1),
        "sentences": sentences,
        "longest": max(map(len, body), default=0),
    }
