"""Broken prompt and response pairs: one answer against its prompt, in plain Python for use in Arrow batches.

The checks, in this order; the first that holds names the defect.

* ``empty``: nothing is left without white space, markup, fences and punctuation, or only a stand-in for no answer.
* ``refusal``: every sentence is taken by the refusal grammar (apology, refusing act, courtesy) and one of them refuses.
* ``copied_question``: greedy string tiling of the answer with the prompt leaves next to nothing of the answer.
* ``other_language``: most of the text is in another language (scripts, then function words) than the one the prompt asks
  for or, if it asks for none, is written in. Short answers too; not judged are texts without words, one or two Latin
  words without a function word (they may be names), fewer than eight Han signs under a Japanese prompt, and which Latin
  language it is if the prompt's is not known.
* ``truncated``: a pushdown parser over fences, brackets, quotations, list items, table rows and markup ends with
  something open, or the last unit of running text ends without an end. A last list item without a terminator is left
  to the corpus: :func:`examine` hands out its tail, which must be one that sentences of all answers close with.

Every check reads the whole text in time linear in its length (the tiling by a suffix automaton); an answer that holds
too few of its prompt's shortest tiles to be covered by them is not tiled.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from tallyloom.llm.languages import FUNCTION_WORDS, asked_language, foreign_words, weights, without_code
from tallyloom.llm.refusals import is_refusal
from tallyloom.llm.shape import FENCE, HEADING, MARKER, RULE_LINE

DEFECTS = ("empty", "refusal", "copied_question", "other_language", "truncated")

_INVISIBLE = re.compile("[​-‏⁠﻿­᠎]")
_MARKUP = re.compile(r"```\w*|~~~|</?[A-Za-z][^<>]*>|&(?:nbsp|amp|lt|gt|quot);")
#: Texts that stand in for no answer, in letters and spaces alone.
NO_ANSWER = {
    "", "na", "n a", "none", "null", "nil", "nan", "undefined", "empty", "no output", "no answer", "no response", "no reply", "no content", "not available", "not applicable", "blank", "tbd", "todo", "unknown", "void",
    "empty output", "empty response", "empty string", "output", "answer", "response", "空", "无", "无输出", "没有输出", "无内容", "无回答", "暂无", "なし", "無し", "出力なし", "回答なし", "leer", "keine ausgabe", "keine antwort", "vide", "aucune sortie", "aucune réponse", "vacío", "vacio", "sin salida", "sin respuesta", "нет", "пусто", "없음",
}


def bare(text: str) -> str:
    """Letters and digits in lower case with single spaces."""
    plain = _MARKUP.sub(" ", text) if "<" in text or "&" in text or "`" in text or "~" in text else text
    plain = plain if plain.isascii() else unicodedata.normalize("NFKC", _INVISIBLE.sub("", plain))
    return re.sub(r"[\W_]+", " ", plain.casefold()).strip()


@lru_cache(maxsize=1)
def _bare(text: str) -> str:
    """The answer in hand; two checks read it."""
    return bare(text)


def is_empty(text: str | None) -> bool:
    return text is None or _bare(text) in NO_ANSWER


# --- copies of the prompt ---------------------------------------------------------------------------------------------
def _automaton(text: str) -> tuple[list[dict[str, int]], list[int], list[int], list[int]]:
    """Suffix automaton of a text: transitions, suffix links, longest lengths, first end positions. Linear."""
    step: list[dict[str, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(text):
        now = len(step)
        step.append({})
        size.append(size[last] + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step, link, size, first


def matches(answer: str, prompt: str) -> tuple[list[int], list[int]]:
    """For each place of the answer the length of the longest match with the prompt that starts there, and where in the
    prompt it stands. One pass through the suffix automaton of the turned prompt, so time is linear."""
    step, link, size, first = _automaton(prompt[::-1])
    longest, at = [0] * len(answer), [0] * len(answer)
    state = length = 0
    for i in range(len(answer) - 1, -1, -1):
        c = answer[i]
        while state and c not in step[state]:
            state = link[state]
            length = size[state]
        if c in step[state]:
            state = step[state][c]
            length += 1
        else:
            state = length = 0
        longest[i] = length
        at[i] = len(prompt) - 1 - first[state]
    return longest, at


def tiled(answer: str, prompt: str, least: int) -> tuple[int, int]:
    """Characters of the answer and of the prompt covered by greedy string tiling with tiles of at least ``least`` characters.

    The longest match of parts not yet tiled becomes a tile, on both sides, until none is left; of equal ones the first
    in the answer. An answer may give the prompt back several times, so each character of the prompt may be tiled as
    often as the prompt goes into the answer. A match that lost characters to longer tiles goes on with its first free
    part; if the prompt's side is used up, with the next place where the same characters stand.
    """
    longest, at = matches(answer, prompt)
    times = -(-len(answer) // max(len(prompt), 1))
    taken = bytearray(len(answer))
    used = [0] * len(prompt)
    # Matches by length; a place whose match is only the rest of the one before it starts no match of its own.
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(max(longest, default=0) + 1)]
    for i in range(len(answer) - 1, -1, -1):
        if longest[i] >= least and not (i and longest[i - 1] == longest[i] + 1):
            waiting[longest[i]].append((i, at[i]))
    full = bytearray(len(prompt))
    covered = 0

    def wait(i: int, p: int, n: int) -> None:
        if n >= least:
            waiting[n].append((i, p))

    for n in range(len(waiting) - 1, least - 1, -1):
        queue = waiting[n]
        while queue:
            i, p = queue.pop()
            end = i + n
            free = taken.find(0, i, end)
            if free < 0:
                continue
            stop = taken.find(1, free, end)
            if free > i or stop >= 0:
                stop = end if stop < 0 else stop
                wait(free, p + free - i, stop - free)
                wait(stop, p + stop - i, end - stop)
                continue
            blocked = full.find(1, p, p + n)
            if blocked < 0:
                taken[i:end] = b"\x01" * n
                covered += n
                for k in range(p, p + n):
                    used[k] += 1
                    full[k] = used[k] >= times
                continue
            after = full.find(0, blocked, p + n)
            if blocked == p and after < 0:
                elsewhere = prompt.find(answer[i:end], p + 1)
                if elsewhere >= 0:
                    wait(i, elsewhere, n)
                continue
            wait(i, p, blocked - p)
            if after >= 0:
                wait(i + after - p, after, p + n - after)
    return covered, sum(map(bool, used))


@lru_cache(maxsize=4096)
def _bare_prompt(prompt: str) -> str:
    return bare(prompt).replace(" ", "")


@lru_cache(maxsize=4096)
def _tiles(prompt: str, least: int) -> frozenset[tuple[str, ...]]:
    """The shortest tiles of a prompt; prompts meet many answers."""
    return frozenset(zip(*(prompt[i:] for i in range(least)), strict=False))


def is_copy(text: str, prompt: str) -> bool:
    a, p = _bare(text).replace(" ", ""), _bare_prompt(prompt)
    if not a or not p:
        return False
    least = min(5, max(2, len(p) // 4))
    # A tile of n characters starts n - least + 1 shortest tiles, so it has at most ``least`` times as many characters.
    if least * sum(map(_tiles(p, least).__contains__, zip(*(a[i:] for i in range(least)), strict=False))) < 0.6 * len(a):
        return False
    of_answer, of_prompt = tiled(a, p, least)
    return of_prompt >= 0.8 * len(p) and len(a) - of_answer <= max(14, 0.25 * len(a)) and of_answer >= 0.6 * len(a)


# --- language -----------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=4096)
def expected_language(prompt: str) -> str | None:
    """The language asked for, else the prompt's own: "latin" if that has no list of words, None without words."""
    asked = asked_language(prompt)
    found = weights(prompt)
    if asked or not found:
        return asked
    own = max(found, key=lambda x: found[x])
    return "latin" if own in FUNCTION_WORDS and foreign_words(without_code(prompt), own, found) else own


def other_language(text: str, prompt: str) -> bool:
    expected = expected_language(prompt)
    if expected is None:
        return False
    plain = without_code(text)
    found = weights(plain, coded=False)
    total = sum(found.values())
    foreign = 0.0
    for language, n in found.items():
        if language == "latin" or language in FUNCTION_WORDS:
            foreign += n * foreign_words(plain, expected, found)
        elif language != expected and not (language == "zh" and expected == "ja" and total < 4):
            # A few Han signs without kana may be Japanese.
            foreign += n
    return foreign > 0.5 * total


# --- truncation ---------------------------------------------------------------------------------------------------------
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "«": "»", "„": "“", "‹": "›", "〔": "〕", "［": "］"}
_CLOSERS = {c: o for o, c in _PAIRS.items()}
_SPACELESS = re.compile(r"[぀-ヿ㐀-䶿一-鿿฀-๿]")
_MARKS = re.compile(f"[{re.escape(''.join({*_PAIRS, *_CLOSERS}))}\"`]")
_END = re.compile(r"[.!?。！？।؟…]+[\"'”’»“」』）)\]】》*_`]*$")
_HANGING = re.compile(r"[,，、;；\-–—/\\(（\[「『“«:：=+&＝]$")
#: Words after which no sentence ends.
_CONNECTIVE = re.compile(
    r"(?:^|[\s,，、;；])(?:and|or|but|because|so that|so that the|the|a|an|of|to|with|which|that|while|if|when|since|although|as|by|for|in|on|from|und|oder|aber|weil|dass|damit|der|die|das|mit|von|wenn|et|ou|mais|parce que|car|que|qui|de|la|le|les|avec|si|y|o|pero|porque|que|el|los|las|con|para|cuando)$|(?:因为|并且|而且|同时把|但是在|但是|所以|以及|或者|如果|由|把|在|和|与|及|将|对|从|但|且|的时候就|または|そして|しかし|ので|から|けれど|また|および|など、|、)$",
    re.I,
)
_CODE_TAIL = re.compile(r"(?:[\w.\-]*[/\\][\w./\\\-]+|\w+_\w+|[a-z]+[A-Z]\w*|\w+\(\)|--?\w[\w\-]*(?:[ =]\w+)?|\w+\.\w{1,4}|`[^`]+`|v?\d+(?:\.\d+)*)$")
#: A name before a colon: no sentence's signs in it and few words.
_LABEL = re.compile(r"([^:：。.!?，,、;；]+)[:：]\s*(\S.*)$", re.S)


_CLOSING = " \t\"'”’»“«」』）)]》】*_`"
#: No connective word is longer than this, so the last signs of a text tell whether it ends in one.
LONGEST_CONNECTIVE = 16


def _has_end(text: str) -> bool:
    """Whether a text ends with a terminator, but for the marks that close behind it."""
    return text.rstrip(_CLOSING)[-1:] in tuple(".!?。！？।؟…")


def _hangs(text: str) -> bool:
    """Whether a text ends with a mark or a word that something must follow."""
    return bool(_HANGING.search(text[-1:]) or _CONNECTIVE.search(text[-LONGEST_CONNECTIVE:]))


def _is_label(line: str) -> bool:
    """A line of a name and its value, as commands, files or functions are given: few words, no sentence."""
    found = _LABEL.match(line)
    return bool(found) and len(found.group(1).split()) <= 4 and not re.search(r"[，,]", line)


def _only_code(line: str) -> bool:
    """A short label of words and, at its end, a path, a call or a name: no sentence of its own."""
    words = line.split()
    return len(words) + len(_SPACELESS.findall(line)) / 2 <= 20 and bool(_CODE_TAIL.search(words[-1])) and not re.search(r"[，,、]", line)




class _Open:
    """The stack of open brackets and quotations. Each kind of opener has its own stack of places, so that a mark that
    closes finds its opener, drops what was opened behind it, and the parse stays linear."""

    def __init__(self) -> None:
        self.places: list[str] = []
        self.count: dict[str, int] = {}

    def push(self, mark: str) -> None:
        self.places.append(mark)
        self.count[mark] = self.count.get(mark, 0) + 1

    def close(self, mark: str) -> bool:
        if not self.count.get(mark):
            return False
        while True:
            top = self.places.pop()
            self.count[top] -= 1
            if top == mark:
                return True

    def top(self) -> str:
        return self.places[-1] if self.places else ""

    def drop(self, marks: str) -> None:
        """Forgets open marks that do not reach over the end of a block."""
        if any(self.count.get(m) for m in marks):
            self.places = [p for p in self.places if p not in marks]
            self.count = {m: 0 if m in marks else n for m, n in self.count.items()}


def parse(text: str) -> tuple[str, list[str], str]:
    """Pushdown parse: what is open at the end ("fence"; "bracket", opened in the last block; "earlier", opened in a
    block before it; or ""), the last block's lines, and its kind ("code", "table", "item", "heading", "text" or "").

    Brackets and paired quotations stay open over the ends of blocks, for they may enclose several; straight quotation
    marks and code marks, which open and close alike, do not.
    """
    stack, before = _Open(), 0
    fence = ""
    block: list[str] = []
    kind = ""
    for raw in re.split(r"\r\n|\r|\n", text.rstrip()):
        bare_line = raw.strip()
        mark = FENCE.match(raw)
        if fence:
            if mark and bare_line.startswith(fence[:3]) and not bare_line.strip("`~"):
                fence, block, kind = "", [], "code"
            continue
        item = MARKER.match(raw)
        opens = mark and (bare_line.count("```") % 2 == 1 or bare_line.startswith("~~~"))
        heading = HEADING.match(raw)
        row = bare_line.startswith("|") or raw.count("|") >= 2 or bool(bare_line) and bool(RULE_LINE.match(raw))
        if opens or not bare_line or heading or row or item:
            stack.drop('"`')
            before = len(stack.places)
        if opens:
            fence, block, kind = mark.group(1)[:3], [], "code"
        elif not bare_line:
            block = []
        elif heading:
            block, kind = [raw], "heading"
        elif row:
            if kind != "table":
                block = []
            block.append(raw)
            kind = "table"
        else:
            if item:
                block, kind = [raw], "item"
            else:
                if kind != "item" or not block:
                    block = block if kind == "text" else []
                    kind = "text"
                block.append(raw)
            for m in _MARKS.finditer(raw, item.end() if item else 0):
                c = m.group()
                if c in '"`':
                    if not stack.close(c):
                        stack.push(c)
                elif stack.top() == "`":
                    continue
                elif c in _CLOSERS and stack.close(_CLOSERS[c]):
                    before = min(before, len(stack.places))
                elif c in _PAIRS:
                    stack.push(c)
                before = min(before, len(stack.places))
    found = "fence" if fence else "bracket" if len(stack.places) > before else "earlier" if stack.places else ""
    return found, block, kind


def tail_key(unit: str) -> str:
    """What a unit ends with: the last word, or the last three signs of a script without spaces."""
    end = len(unit)
    while end and not unit[end - 1].isalnum():
        end -= 1
    if not end:
        return ""
    if _SPACELESS.match(unit[end - 1]):
        return unit[max(end - 3, 0) : end]
    start = max(unit.rfind(c, 0, end) for c in " \t\n(（「“\"")
    word = unit[start + 1 : end]
    # A word with a sign that only paths, calls and names have, or with inner capitals.
    if _CODE_TAIL.search(word):
        return "<code>"
    return re.sub(r"\d+", "0", word.casefold())


_STOP = re.compile(r"[!?]+|\.+(?=[\s\"'”’»)\]]|$)|[。！？।؟]+|\n")


def closings(text: str) -> set[str]:
    """Tails of all sentences of a text that are closed by a terminator."""
    out, last = set(), 0
    for m in _STOP.finditer(text):
        a = m.start()
        if m.group() != "\n" and a - last >= 4:
            key = tail_key(text[last:a])
            if key:
                out.add(key)
        last = m.end()
    return out


def truncation(text: str) -> tuple[bool, str]:
    """(certainly truncated, tail to look up or "")."""
    opened, block, kind = parse(text)
    if opened == "fence":
        return True, ""
    if kind == "code" or not block:
        return False, ""
    last = block[-1].strip()
    if kind == "heading":
        return True, ""
    if kind == "table":
        rows = [b.strip() for b in block]
        closed = sum(r.endswith("|") for r in rows[:-1])
        cells = [r.strip("|").count("|") for r in rows]
        return len(rows) > 1 and (closed == len(rows) - 1 and not last.endswith("|") or cells[-1] < min(cells[:-1])), ""
    if opened == "bracket":
        return True, ""
    if _has_end(last):
        return False, ""
    if kind == "item" and len(block) == 1:
        mark = MARKER.match(last)
        content = last[mark.end() :].strip() if mark else last
        if not content or opened or _hangs(content):
            return True, ""
        return False, tail_key(content)
    if opened or _HANGING.search(last[-1:]):
        return True, ""
    if last.endswith(("**", "__")) or not re.search(r"\w", last):
        return False, ""
    if len(block) == 1 and (_only_code(last) or _is_label(last)):
        return False, ""
    return True, ""


def examine(text: str | None, prompt: str | None) -> tuple[str | None, str]:
    """(defect or None, tail to look up or "")."""
    if is_empty(text):
        return "empty", ""
    if is_refusal(text):
        return "refusal", ""
    if prompt and is_copy(text, prompt):
        return "copied_question", ""
    if prompt and other_language(text, prompt):
        return "other_language", ""
    cut, tail = truncation(text)
    return ("truncated" if cut else None), tail
