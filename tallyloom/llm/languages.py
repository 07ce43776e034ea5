"""Which language a text is in: scripts first, function words where a script is shared. Plain Python for use in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or of to in is are was were be been it that this which who with for on at by from as not no if we you they he she has have had can may will would should could do does did but so than then there their its our your how what why when where is any still please out i me my us something",
    "de": "der die das den dem des ein eine einen einem einer und oder nicht kein keine ist sind war wird werden wurde mit von vor nach bei für auf aus zu zum zur im in an am dass weil wenn wir sie es ich nur noch sich hat haben als auch wie was warum nur so dieselbe bitte dazu diese dieser",
    "fr": "le la les un une des du de et ou ne pas est sont a ont été qui que quoi ce cette ces pour par dans sur avec sans en au aux nous vous ils elle il se sa son ses si car plus mais comme depuis avant après deux encore peut faut aucun rien l d n s qu",
    "es": "el la los las un una unos unas de del y o no es son fue ha han que quien este esta estos para por con sin en al se su sus si porque más pero como desde antes después dos todavía hay lo nos muy ya cuando qué casi todos hace falta",
    "it": "il lo la gli le un una di del della e o non è sono che chi questo questa per con senza in al si su se perché più ma come da prima dopo due ancora",
    "pt": "o a os as um uma de do da e ou não é são que quem este esta para por com sem em ao se seu sua mas como desde antes depois dois ainda há",
    "nl": "de het een en of niet geen is zijn was wordt met van voor na bij op uit te dat omdat als wij ze ik nog zich heeft ook hoe wat waarom deze",
}
_WORDS: dict[str, tuple[str, ...]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _WORDS[_w] = (*_WORDS.get(_w, ()), _language)

#: Script ranges, by code point.
SCRIPTS = re.compile(r"(?P<kana>[぀-ヿㇰ-ㇿｦ-ﾝ])|(?P<han>[㐀-䶿一-鿿\uf900-\ufaff々])|(?P<hangul>[가-힯ᄀ-ᇿ㄰-㆏])|(?P<thai>[฀-๿])|(?P<arabic>[؀-ۿݐ-ݿ])|(?P<deva>[ऀ-ॿ])|(?P<cyrl>[Ѐ-ӿ])|(?P<greek>[Ͱ-Ͽ])|(?P<hebrew>[֐-׿])")
_FENCE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
#: Runs of ASCII signs that hold a sign of code are paths, identifiers, rule names, addresses or numbers: the same in
#: every language.
_CODED = re.compile(r"[/\\_0-9]|[a-z][A-Z]|[A-Z]-[A-Z]|^\W*--\w|\w\.(?:py|js|ts|java|vue|json|md|sh|yml)\b|\(\)", re.ASCII)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_LATIN_WORD = re.compile(r"[A-Za-zÀ-ɏ]+")
_BY_SCRIPT = {"hangul": "ko", "thai": "th", "arabic": "ar", "deva": "hi", "cyrl": "ru", "greek": "el", "hebrew": "he"}


def without_code(text: str) -> str:
    """The text without code, markup, paths, names and numbers."""
    plain = _TAG.sub(" ", text) if "<" in text else text
    plain = _FENCE.sub(" ", plain) if "`" in plain else plain
    return "".join(run if run.isalpha() and run.islower() or not _CODED.search(run) else " " for run in _SPLIT.split(plain))


#: Runs of visible ASCII signs and what stands between them.
_SPLIT = re.compile(r"([!-~]+)")


class _Scripts(dict):
    """Character -> the name of its script or "", found once: at most one entry for each code point."""

    def __missing__(self, c: str) -> str:
        found = SCRIPTS.match(c)
        self[c] = found.lastgroup if found else ""
        return self[c]


_SCRIPT_OF = _Scripts()


def weights(text: str, coded: bool = True) -> dict[str, float]:
    """Language -> amount of text; a Han or kana sign counts as much as two Latin letters' words do (half a word)."""
    plain = without_code(text) if coded else text
    scripts: dict[str, int] = {}
    for c, n in Counter(plain).items():
        if c > "\u036f" and (script := _SCRIPT_OF[c]):
            scripts[script] = scripts.get(script, 0) + n
    out: dict[str, float] = {}
    kana, han = scripts.pop("kana", 0), scripts.pop("han", 0)
    if kana + han:
        out["ja" if kana > 0.15 * (kana + han) else "zh"] = (kana + han) / 2
    for script, n in sorted(scripts.items()):
        out[_BY_SCRIPT[script]] = n / (2 if script == "hangul" else 5)
    words = _LATIN_WORD.findall(plain.lower())
    if words:
        votes: dict[str, float] = {}
        for w, n in Counter(words).items():
            for language in _WORDS.get(w, ()):
                votes[language] = votes.get(language, 0) + n / len(_WORDS[w])
        if votes:
            out[max(votes, key=lambda x: (votes[x], x == "en"))] = float(len(words))
        else:
            out["latin"] = float(len(words))
    return out


#: Letters beyond a to z that a language's own words have.
LETTERS = {"en": "", "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü", "it": "àèéìíîòóù", "pt": "àáâãçéêíóôõúü", "nl": "áéèëíïóöúü"}
_OWN = {language: frozenset(words.split()) for language, words in FUNCTION_WORDS.items()}
_ODD = {language: re.compile(rf"[^a-z{letters}]") for language, letters in LETTERS.items()}
#: So many words of running text hold function words; text of a listed language has more than this share of them.
SURE, LEAST_OWN = 10, 0.1
#: Languages whose lists share much with others': these are told by a margin of the words not shared.
CLOSE, MARGIN = {"it", "pt", "nl"}, 1.5


def foreign_words(text: str, expected: str, found: dict[str, float]) -> bool:
    """Whether the Latin words of a text without code are in another language than ``expected``, a language or "latin" (not
    known). ``found`` is the text's weights.

    A listed language is told by the function words that it does not share with the expected one. A language without a
    list is told by what is missing: next to no function words of the expected language, or no more of them than
    words with letters that it does not write.
    """
    # Each word once: one that is said over and over tells no more.
    words = set(_LATIN_WORD.findall(text.lower()))
    top = next((x for x in found if x in _OWN), None)
    n = len(words)
    if expected == "latin" or not n:
        return False
    if expected in _BY_SCRIPT.values() or expected in ("zh", "ja"):
        # One or two words may be names.
        return n > 2 or top is not None
    if expected not in _OWN:
        return top is not None and n >= SURE and len(words & _OWN[top]) >= 2 * LEAST_OWN * n
    if top and top != expected:
        if n >= 6 and not {top, expected} & CLOSE:
            return True
        only_top, only_own = len(words & (_OWN[top] - _OWN[expected])), len(words & (_OWN[expected] - _OWN[top]))
        if only_top >= 2 and only_top > MARGIN * only_own:
            return True
    own, odd = len(words & _OWN[expected]), 0 if text.isascii() else sum(bool(_ODD[expected].search(w)) for w in words)
    return odd >= max(2, own) or n >= SURE and own < LEAST_OWN * n


def main_language(text: str) -> tuple[str | None, float]:
    """The language that most of the text is in, and its share; None for a text without words."""
    found = weights(text)
    total = sum(found.values())
    if not total:
        return None, 0.0
    best = max(found, key=lambda x: found[x])
    return best, found[best] / total


#: Names of languages in the prompts' languages.
LANGUAGE_NAMES = {
    "en": "english|englisch\\w*|anglais\\w*|inglés|inglesa|英语|英文|英語",
    "zh": "chinese|chinesisch\\w*|chinois\\w*|chino|china|中文|汉语|中国語",
    "ja": "japanese|japanisch\\w*|japonais\\w*|japonés|japonesa|日语|日文|日本語",
    "de": "german|deutsch\\w*|allemand\\w*|alemán|alemana|德语|德文|ドイツ語",
    "fr": "french|französisch\\w*|français\\w*|francés|francesa|法语|法文|フランス語",
    "es": "spanish|spanisch\\w*|espagnol\\w*|español|española|西班牙语|西班牙文|スペイン語",
    "ko": "korean|koreanisch\\w*|coréen\\w*|coreano|coreana|韩语|韩文|韓国語",
    "ru": "russian|russisch\\w*|russe|ruso|rusa|俄语|俄文|ロシア語",
    "ar": "arabic|arabisch\\w*|arabe|árabe|阿拉伯语|アラビア語",
    "pt": "portuguese|portugiesisch\\w*|portugais\\w*|portugués|portuguesa|葡萄牙语|ポルトガル語",
    "it": "italian|italienisch\\w*|italien\\w*|italiano|italiana|意大利语|イタリア語",
    "nl": "dutch|niederländisch\\w*|holländisch\\w*|néerlandais\\w*|neerlandés|neerlandesa|holandés|荷兰语|荷兰文|オランダ語",
    "pl": "polish|polnisch\\w*|polonais\\w*|polaco|polaca|波兰语|波兰文|ポーランド語",
    "tr": "turkish|türkisch\\w*|turc|turque|turco|turca|土耳其语|土耳其文|トルコ語",
    "sv": "swedish|schwedisch\\w*|suédois\\w*|sueco|sueca|瑞典语|瑞典文|スウェーデン語",
    "da": "danish|dänisch\\w*|danois\\w*|danés|danesa|丹麦语|デンマーク語",
    "no": "norwegian|norwegisch\\w*|norvégien\\w*|noruego|noruega|挪威语|ノルウェー語",
    "fi": "finnish|finnisch\\w*|finnois\\w*|finlandés|finlandesa|芬兰语|フィンランド語",
    "cs": "czech|tschechisch\\w*|tchèque|checo|checa|捷克语|チェコ語",
    "hu": "hungarian|ungarisch\\w*|hongrois\\w*|húngaro|húngara|匈牙利语|ハンガリー語",
    "ro": "romanian|rumänisch\\w*|roumain\\w*|rumano|rumana|罗马尼亚语|ルーマニア語",
    "vi": "vietnamese|vietnamesisch\\w*|vietnamien\\w*|vietnamita|越南语|越南文|ベトナム語",
    "id": "indonesian|indonesisch\\w*|indonésien\\w*|indonesio|indonesia|印尼语|インドネシア語",
    "th": "thai|thailändisch\\w*|thaï|tailandés|泰语|泰文|タイ語",
    "hi": "hindi|印地语|ヒンディー語",
    "el": "greek|griechisch\\w*|grec|grecque|griego|griega|希腊语|ギリシャ語",
    "he": "hebrew|hebräisch\\w*|hébreu|hebreo|希伯来语|ヘブライ語",
}
_ASKED = {
    language: re.compile(rf"\b(?:in|into|to|auf|ins|en|au|al)\s+(?:the\s+)?(?:{names})\b|(?:用|以|成|译为|译成|为)\s*(?:{names})|(?:{names})(?:版|回答|写|で|に)|\b(?:{names})\s+(?:version|answer|reply|translation)\b", re.I)
    for language, names in LANGUAGE_NAMES.items()
}


def asked_language(prompt: str) -> str | None:
    """The language that a prompt asks for, if it names one."""
    for language, pattern in _ASKED.items():
        if pattern.search(prompt):
            return language
    return None
