"""Refusal grammars: small context-free grammars without recursion, one for each language, over the sentences of an answer.

A sentence of an answer is read by the grammars of its script. ``act`` derives sentences in which the speaker declines;
``courtesy`` what may stand beside one (apologies, thanks, a hint to ask elsewhere or something else). An answer is a
refusal if every sentence is one of the two and at least one is an act. ``<name>`` stands for any production of that
name, ``~`` for a gap of any signs inside the sentence. A grammar is expanded into one pattern when the module is loaded.

Sentences are read whole; an answer is read up to its first sentence that neither refuses nor is courtesy.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

#: Productions by language.
GRAMMARS: dict[str, dict[str, list[str]]] = {
    "en": {
        "act": [
            r"\b<speaker>(?: am| are|'m|'re)?(?: sorry,? but)? ?<not_do> ~\b<help>\b",
            r"\b<speaker> <must> (?:<politely> )?(?:decline|refuse|pass)\b",
            r"\bmust decline\b", r"\bi decline\b", r"\bi refuse\b",
            r"\b<speaker>(?:'d| would) (?:rather|prefer) not\b",
            r"\b<speaker>(?:'ll| will| 'm| am|'m|'d| would| must| have to| need to)? ?(?:going to |like to )?(?:have to )?<stay_out>\b",
            r"\bno comment\b", r"\bno answer from <my> side\b",
            r"\b<my> <rules>\b ~\b(?:keep|prevent|stop|forbid|do(?:es)? not|don't)\b",
            r"\b(?:outside|beyond) (?:of )?(?:what|the scope|my)\b ~\b(?:i|may|can|assist|help|scope|abilit\w*|remit)\b",
            r"\bas a matter of policy\b", r"\bnot something i (?:can|may|will)\b",
        ],
        "speaker": ["i", "we"],
        "my": ["my", "our"],
        "not_do": ["cannot", "can ?not", "can't", "won't", "will not", "(?:am |are )?(?:unable|not able|not permitted|not allowed) to", "(?:must|may) not", "(?:do not|don't) wish to", "(?:refuse|decline|have to decline) to", "(?:am )?not going to"],
        "help": ["answer", "help", "assist", "comply", "discuss", "respond", "reply", "provide", "share", "comment", "do (?:that|this)", "continue", r"fulfil\w*", "support", "say", "talk", "give", "complete", "process"],
        "must": ["must", "have to", "need to", "will have to", "would"],
        "politely": ["politely", "respectfully"],
        "rules": ["guidelines", "rules", "policies", "policy", "instructions"],
        "stay_out": ["sit this (?:one )?out", "pass on (?:this|that)(?: one)?", "leave (?:this|that)(?: one| question)? unanswered", "stay out of (?:this|that)(?: one)?", "keep out of (?:this|that)", "skip this (?:one|question)"],
        "courtesy": [
            r"^(?:(?:i'm|i am|we are|we're) )?(?:(?:very|so|really) )?(?:sorry|apolog\w*|unfortunately|regrettably|with (?:all )?respect|thank you|thanks)\b[^,;:]*[,;:]?[^,;:]*$",
            r"\b(?:feel free to|please) (?:ask|contact|consult|reach|try|refer|get in touch|turn|see)\b", r"\bask (?:me )?(?:something|anything) else\b",
            r"\b(?:please|kindly|try|choose|pick|rephrase)\b ~\b<topic>\b", r"\b(?:another|a different) <topic>\b", r"\b(?:qualified )?(?:specialist|professional|expert)\b",
            r"\bi hope you understand\b", r"\bthank you for (?:your )?(?:understanding|asking|patience)\b", r"\blet me know if\b", r"\bi understand\b",
        ],
        "topic": ["questions?", "topics?", "subjects?", "requests?", "prompts?"],
    },
    "zh": {
        "act": [
            r"<speaker>.{0,8}<not_do>", r"<only>我?<declines>", r"不(?:作|予|便)<reply>", r"(?:这个|该|此)?<topic>.{0,4}我?(?:无法|不能|不便)(?:回答|回应|处理|协助)",
            "不归我答", r"超出了?我.{0,8}(?:范围|能力)", "无可奉告", "不便(?:提供|透露|回答)",
        ],
        "speaker": ["我", "这里", "本人", "我们"],
        "not_do": ["不能", "无法", "不会", "不便", "不可以", "没法", "不愿", "拒绝", "没有权限", "无权", "不提供", "不予", "选择不", "不作", "不方便"],
        "only": ["恕", "只能", "不得不", "必须"],
        "declines": ["不能", "婉拒", "拒绝", "难以", "无法"],
        "reply": ["回应", "回答", "答复", "透露", "提供", "评论", "置评"],
        "topic": ["问题", "请求", "要求"],
        "courtesy": [
            r"^(?:抱歉|对不起|很遗憾|非常抱歉|不好意思|谢谢|感谢|请谅解|望谅解|敬请|请见谅|见谅).{0,20}$", r"请?(?:咨询|联系|询问|求助).{0,14}(?:专业|人士|专家|团队|客服|负责人|他人)",
            r"请?(?:另|再)?(?:换|选|提)一?个(?:别的|其他)?(?:问题|话题)", r"(?:如|若)?有?其他(?:需要|问题)", "望谅解", "理解你", "再来问我", "欢迎",
        ],
    },
    "ja": {
        "act": [
            r"お答え<not_do>", r"回答(?:を|は)?(?:控え|差し控え|お断り|できません|いたしかね)", r"お手伝い<not_do>", r"(?:申し上げ|お話し|対応|お応え|お伝え)(?:られません|<not_do>)",
            "何も申し上げられません", "お断り(?:し|いた|させ)", "ご?遠慮(?:させ|いた)",
        ],
        "not_do": ["できません", "できかね", "いたしかね", "しかねます"],
        "courtesy": [r"^(?:申し訳|恐れ入り|すみません|残念ながら|大変恐縮).{0,20}$", r"ご(?:了承|理解|容赦|相談|連絡|遠慮)", r"専門(?:の方|家)", r"別の(?:質問|ご質問)", "お尋ねください"],
    },
    "de": {
        "act": [
            r"\b<may>\b ~\bich\b ~\b<no>\b", r"\bich\b.{0,12}\b(?:<may>|muss)\b ~\b(?:<no>|ablehnen|absagen|verweigern)\b", r"\b(?:muss|möchte)\b ~\bablehnen\b",
            r"\bkeine auskunft\b", r"\bdazu sage ich nichts\b", r"\bkein kommentar\b",
        ],
        "may": ["kann", "darf", "werde", "möchte", "will"],
        "no": ["nicht", "keine?n?"],
        "courtesy": [
            r"^(?:leider|es tut mir leid|tut mir leid|entschuldigung|danke|vielen dank|bei allem verständnis|bedaure)\b[^,;:]*[,;:]?[^,;:]*$",
            r"\b(?:wenden sie sich|fragen sie|bitte (?:fragen|wenden|stellen)|fachleute|fachperson|fachkraft|fachmann|ich bitte um verständnis|danke für (?:ihr|dein) verständnis|andere frage|etwas anderes|verständnis)\b",
        ],
    },
    "fr": {
        "act": [
            r"\bje (?:ne|n') ?<may> ~\b(?:pas|rien|aucun\w*)\b", r"\bje (?:préfère|préférerais) ne\b", r"\bje (?:dois|regrette de devoir) (?:décliner|refuser)\b", r"\bil m'est impossible\b", r"\bje (?:décline|refuse)\b",
            r"\baucun commentaire\b", r"\bsans commentaire\b", r"\bpas en mesure\b",
        ],
        "may": ["peux", "puis", "suis", "veux", "souhaite", "dois", "saurais"],
        "courtesy": [
            r"^(?:désolée?|malheureusement|je regrette|pardon|merci|je suis désolée?)\b[^,;:]*[,;:]?[^,;:]*$",
            r"\b(?:veuillez|adressez|consultez|demandez|posez|n'hésitez pas|merci de votre compréhension|un spécialiste|un expert|autre question|autre chose|question différente|compréhension)\b",
        ],
    },
    "es": {
        "act": [r"\bno (?:me )?<may>\b", r"\b(?:debo|tengo que|he de) (?:rechazar|declinar|negarme)\b", r"\bprefiero no\b", r"\bme niego\b", r"\bsin comentarios\b", r"\bdeclino\b"],
        "may": ["puedo", "podemos", "me es posible", "es posible", "me está permitido", "está permitido", "voy a", "quiero", "deseo"],
        "courtesy": [
            r"^(?:lo siento|por desgracia|lamentablemente|perdón|disculp\w+|gracias|lo lamento)\b[^,;:]*[,;:]?[^,;:]*$",
            r"\b(?:consulte|consulta|pregunte|pregúnteme|pregunta\w*|diríjase|acuda|gracias por su comprensión|un especialista|un experto|otra cosa|otra pregunta|pregunta distinta|comprensión|hable con)\b",
        ],
    },
    "ru": {
        "act": [r"\bне (?:могу|буду|вправе|готов\w*)\b", r"\bвынужден\w* (?:отказать|отклонить)\w*", r"\bбез комментариев\b"],
        "courtesy": [r"^(?:к сожалению|извините|простите|спасибо).{0,40}$"],
    },
    "ko": {
        "act": ["답변(?:할 수 없|드릴 수 없|을 거절|을 삼가)", "도와드릴 수 없"],
        "courtesy": [r"^(?:죄송합니다|미안합니다).{0,40}$"],
    },
}
#: Which grammars read a sentence, by the signs in it.
SCRIPTS = (
    (re.compile(r"[A-Za-zÀ-ɏ]{2}"), ("en", "de", "fr", "es")),
    (re.compile(r"[一-鿿]"), ("zh", "ja")),
    (re.compile(r"[぀-ヿ]"), ("ja",)),
    (re.compile(r"[Ѐ-ӿ]"), ("ru",)),
    (re.compile(r"[가-힯]"), ("ko",)),
)


def derive(grammar: dict[str, list[str]], name: str, inside: tuple[str, ...] = ()) -> str:
    """The pattern of all sentences that a name derives; a name that leads back to itself is refused."""
    if name in inside:
        raise ValueError(f"{name} derives itself")
    return "(?:" + "|".join(re.sub(r"<(\w+)>", lambda m: derive(grammar, m.group(1), (*inside, name)), p).replace("~", ".*?") for p in grammar[name]) + ")"


_PATTERNS = {language: {name: re.compile(derive(g, name), re.I) for name in ("act", "courtesy")} for language, g in GRAMMARS.items()}
_SENTENCE = re.compile(r"[^.!?。！？\n]*[.!?。！？]+[\"'”’»」』)\]）]*(?=\s|$)|[^.!?。！？\n]*[。！？]+[”’」』）]*|[^\n]+")


def sentences(text: str) -> Iterator[str]:
    return (s for m in _SENTENCE.finditer(text) if (s := m.group().strip(" \t\"'“”「」*_>#-")) and re.search(r"\w", s))


def read(sentence: str, name: str) -> bool:
    """Whether a grammar of the sentence's script derives it, or a part of it, from the name."""
    languages = {x for signs, of_script in SCRIPTS if signs.search(sentence) for x in of_script}
    return any(_PATTERNS[x][name].search(sentence) for x in GRAMMARS if x in languages)


def is_refusal(text: str) -> bool:
    refused = False
    for s in sentences(unicodedata.normalize("NFKC", text).replace("’", "'")):
        if read(s, "act"):
            refused = True
        elif not read(s, "courtesy"):
            return False
    return refused
