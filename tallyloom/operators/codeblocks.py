"""Code in texts: token windows shared by texts, and the structural parser behind the method rules."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens in a window, step between windows.
WINDOW, STEP = 40, 10
_TOKEN = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[A-Za-z_]\w*|\d+(?:\.\d+)?|\S')
KEYWORDS = frozenset("if else for while return class public private protected static void int long double boolean new try catch finally throw throws def in not and or import from switch case break continue".split())


def normalised_tokens(code: str) -> list[str]:
    """Keywords and signs stay, names, numbers and strings become ID, NUM, STR."""
    out = []
    for t in _TOKEN.findall(code):
        if t[0] in "\"'" and len(t) > 1:
            out.append("STR")
        elif t[0].isdigit():
            out.append("NUM")
        elif t[0].isalpha() or t[0] == "_":
            out.append(t if t in KEYWORDS else "ID")
        else:
            out.append(t)
    return out


def windows(files: DataFrame, key: str, code: str, size: int = WINDOW, step: int = STEP) -> DataFrame:
    """(key, start, print): a fingerprint of each window of normalised tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["key"], batch["code"], strict=True):
                t = normalised_tokens(text or "")
                rows += [(k, i, " ".join(t[i : i + size])) for i in range(0, len(t) - size + 1, step)]
            yield pd.DataFrame(rows, columns=["key", "start", "tokens"])

    flat = files.select(F.col(key).alias("key"), F.col(code).alias("code")).mapInPandas(run, f"key {dict(files.dtypes)[key]}, start int, tokens string")
    return flat.select("key", "start", F.sha2("tokens", 256).alias("print"))


def duplicate_blocks(files: DataFrame, key: str, code: str, size: int = WINDOW, least: int = 100, kinds: int = 1) -> DataFrame:
    """(key, start, tokens, first_key, first_start): the longest stretches of a text's normalised tokens all of whose windows
    of ``size`` tokens stand somewhere before: in a text with a smaller key, or earlier in the same one without overlap.
    Stretches of ``least`` tokens or more are kept, with the place where their first window stands first.

    Windows start at every token, so copies at any offset meet. A window is looked up among the first places of all
    windows, never paired with its other copies. ``kinds`` drops stretches whose first window has fewer distinct tokens.
    A fingerprint is 96 bits of two hashes. Windows of one text are numbered by their own start; the first places are a
    map-side combined aggregate, hot windows included.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "tokens": [normalised_tokens(t or "") for t in batch["code"]]})

    flat = files.select(F.col(key).alias("key"), F.col(code).alias("code")).mapInPandas(run, f"key {dict(files.dtypes)[key]}, tokens array<string>").where(F.size("tokens") >= size)
    window = lambda i: F.slice("tokens", i + 1, size)
    marks = F.transform(F.sequence(F.lit(0), F.size("tokens") - size), lambda i: F.struct(F.xxhash64(window(i)).alias("a"), F.hash(window(i)).alias("b"), F.size(F.array_distinct(window(i))).alias("kinds")))
    prints = flat.select("key", F.posexplode(marks).alias("start", "p")).select("key", "start", "p.a", "p.b", "p.kinds")
    firsts = prints.groupBy("a", "b").agg(F.min(F.struct("key", "start")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    repeated = prints.join(firsts, ["a", "b"]).where((F.col("first.key") != F.col("key")) | (F.col("first.start") <= F.col("start") - size))
    runs = repeated.withColumn("_run", F.col("start") - F.row_number().over(Window.partitionBy("key").orderBy("start")))
    found = runs.groupBy("key", "_run").agg(F.min(F.struct("start", "first", "kinds")).alias("f"), (F.count(F.lit(1)) + size - 1).alias("tokens"))
    return found.where((F.col("tokens") >= least) & (F.col("f.kinds") >= kinds)).select("key", F.col("f.start").alias("start"), "tokens", F.col("f.first.key").alias("first_key"), F.col("f.first.start").alias("first_start"))


def shared_windows(prints: DataFrame) -> DataFrame:
    """(print, files, first_key, first_start, windows): windows that stand in two or more files.

    One row for each class of equal windows with its membership counts; copies are never expanded into pairs.
    """
    return (
        prints.groupBy("print")
        .agg(F.count_distinct("key").alias("files"), F.min(F.struct("key", "start")).alias("first"), F.count(F.lit(1)).alias("windows"))
        .where("files >= 2")
        .select("print", "files", F.col("first.key").alias("first_key"), F.col("first.start").alias("first_start"), "windows")
    )


# --- structural parser ------------------------------------------------------------------------------------------------
_METHOD = re.compile(r"(?:(?:public|private|protected|static|final|synchronized|abstract)\s+)+[\w<>\[\], ?.]+?\s+(\w+)\s*\(([^()]*)\)\s*(?:throws\s+[\w., ]+)?\{")
_BRANCH = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||(?<!<)\?(?!>)")
_PART = re.compile(r"\b(?:if|else|for|while|do|switch|try|catch|finally)\b|[{}();]")
#: Limits of the method rules.
LINES, BRANCHES, DEPTH, PARAMETERS = 80, 15, 4, 5
_BRACE = re.compile(r"[{}]")
_QUOTED = re.compile(r"[\"'/]")


def blank(code: str) -> str:
    """The code with comments and strings blanked out, same length, same lines."""
    out, i, n = list(code), 0, len(code)
    while i < n:
        two = code[i : i + 2]
        if two == "//":
            while i < n and code[i] != "\n":
                out[i] = " "
                i += 1
        elif two == "/*":
            end = code.find("*/", i + 2)
            end = n if end < 0 else end + 2
            for k in range(i, end):
                if code[k] != "\n":
                    out[k] = " "
            i = end
        elif code[i] in "\"'":
            quote, k = code[i], i + 1
            while k < n and code[k] != quote and code[k] != "\n":
                k += 2 if code[k] == "\\" else 1
            for j in range(i + 1, min(k, n)):
                if code[j] != "\n":
                    out[j] = " "
            i = k + 1
        else:
            mark = _QUOTED.search(code, i + 1)
            i = mark.start() if mark else n
    return "".join(out)


def braces(plain: str) -> dict[int, int]:
    """Place of every opening brace -> place of the brace that closes it, in one pass; what never closes is left out."""
    out, stack = {}, []
    for m in _BRACE.finditer(plain):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def methods(code: str) -> list[dict]:
    """Methods of Java-like code with lines, branches, nesting and parameters, by one brace machine over the whole text.

    Methods may stand in each other (local and anonymous classes). Parts of the code are counted once, by running totals
    and by a stack of open methods, so time is linear in the text and its methods whatever their nesting.
    """
    plain = blank(code)
    closes = braces(plain)
    lines = [m.start() for m in re.finditer("\n", plain)]
    branches = [m.start() for m in _BRANCH.finditer(plain)]
    found, starts = [], {}
    for m in _METHOD.finditer(plain):
        opened = m.end() - 1
        end = closes.get(opened, len(plain))
        starts[opened] = len(found)
        found.append(
            {
                "name": m.group(1), "start_line": bisect_left(lines, m.start()) + 1, "end_line": bisect_left(lines, end) + 1,
                "cyclomatic": 1 + bisect_left(branches, end) - bisect_left(branches, m.end()), "nesting": 0, "parameters": len([p for p in m.group(2).split(",") if p.strip()]), "at": (m.end(), end),
            }
        )
    # Nesting: the control blocks open since each open method began; a method takes the deepest of what it holds.
    stack: list[tuple[int, bool]] = []
    open_methods: list[list[int]] = []
    level = parens = 0
    pending = False
    for t in _PART.finditer(plain):
        part = t.group()
        if part == "{":
            if t.start() in starts:
                open_methods.append([starts[t.start()], level, level])
                stack.append((1, False))
            else:
                stack.append((0, pending))
                level += pending
                if open_methods:
                    open_methods[-1][2] = max(open_methods[-1][2], level)
            pending = False
        elif part == "}":
            if stack:
                is_method, control = stack.pop()
                level -= control
                if is_method and open_methods:
                    index, base, deepest = open_methods.pop()
                    found[index]["nesting"] = deepest - base
                    if open_methods:
                        open_methods[-1][2] = max(open_methods[-1][2], deepest)
            pending = False
        elif part in "()":
            parens += 1 if part == "(" else -1
        elif part == ";":
            pending = pending and parens > 0
        else:
            pending = True
    for index, base, deepest in open_methods:
        found[index]["nesting"] = deepest - base
    return found


_LOOP = r"\b(?:for|while)\s*\([^)]*\)\s*\{[^{}]*"
#: Calls that leave the process, from the public documentation of the JDK and of common libraries: type or variable name
#: endings and the methods that send.
SENDERS = {"[Cc]lient": "fetch|call|request|send|get|post|put|delete", "[Hh]ttp": "send|sendAsync|execute|newCall", "[Tt]emplate": "exchange|getForObject|getForEntity|postForObject|postForEntity|convertAndSend", "[Ss]tub": "\\w+", "[Pp]roducer": "send", "[Rr]emote": "\\w+", "[Gg]ateway": "\\w+"}
_REMOTE = "(?:" + "|".join(rf"\b\w*{name}\w*\.(?:{calls})\(" for name, calls in SENDERS.items()) + ")"
#: Rules on the body of a method as data: (rule, severity, what must be there, what must not).
BODY_RULES = tuple(
    (rule, severity, re.compile(there, re.S), re.compile(absent, re.S) if absent else None)
    for rule, severity, there, absent in (
        ("EMPTY-CATCH", "HIGH", r"catch\s*\([^)]*\)\s*\{\s*\}", None),
        ("CATCH-RETURN-NULL", "HIGH", r"catch\s*\([^)]*\)\s*\{[^{}]*return\s+null\s*;[^{}]*\}", None),
        ("SWALLOW-AND-SUCCESS", "HIGH", r"catch\s*\([^)]*\)\s*\{[^{}]*return\s+(?:true|\w+\.(?:ok|success)\([^)]*\))\s*;[^{}]*\}", None),
        ("GENERIC-CATCH", "LOW", r"catch\s*\(\s*(?:final\s+)?(?:Exception|Throwable)\b", None),
        ("RETRY-AMPLIFY", "HIGH", _LOOP + r"\b(?:retry\w*|\w*[rR]etry)\s*\(", r"\b(?:backoff|sleep|maxAttempts)\b"),
        ("UNCLOSED-RESOURCE", "HIGH", r"\bnew\s+(?:File(?:Input|Output)Stream|FileReader|FileWriter|Socket)\b", r"\.close\(\)|try\s*\("),
        ("EXECUTOR-PER-CALL", "HIGH", r"Executors\.new\w+\(", r"\.shutdown"),
        ("SEMAPHORE-LEAK", "HIGH", r"\.acquire\(", r"finally\s*\{[^{}]*\.release\("),
        ("LOCK-REMOTE-CALL", "HIGH", r"(?:synchronized\s*\([^)]*\)\s*\{|\.lock\(\)).*" + _REMOTE, None),
        ("NPLUS1", "HIGH", _LOOP + r"\.(?:find\w*|select\w*|query\w*|get\w*ById|load\w*)\(", None),
        ("ON2", "MEDIUM", r"\bfor\s*\([^)]*\)\s*\{(?:[^{}]|\{[^{}]*\})*?\b(?:for\s*\([^)]*\)\s*\{[^{}]*)\.(?:contains|indexOf|equals)\(", None),
        ("REPEAT-SERIALIZE", "MEDIUM", _LOOP + r"(?:toJson|writeValueAsString|JSON\.toJSONString)\(", None),
        ("UNBOUNDED-IN", "MEDIUM", r"\.(?:findAllById|selectBatchIds|in)\(\s*\w*[iI]ds\b", r"\b(?:partition|subList|limit)\b"),
    )
)
_FIELD = re.compile(r"(?:^|(?<=[;{}]))\s*(?:(?:private|public|protected|static|final|volatile)\s+)+[\w<>\[\], ?]+?\s+(\w+)\s*(?:=[^;]*)?;", re.M)
_LOCKED = re.compile(r"if\s*\(\s*(\w+)\s*==\s*null\s*\)\s*\{\s*synchronized[^{]*\{\s*if\s*\(\s*\1\s*==\s*null")
_STATIC_MUTABLE = re.compile(r"\bstatic\s+(?!final\b)(?:\w+\s+)*?[\w<>, ]*\b(?:Map|List|Set|HashMap|ArrayList|HashSet)\b[\w<>, ]*\s+(\w+)")


def own_body(m: dict, inner: list[tuple[int, int]], plain: str) -> str:
    """The body of a method without the bodies of methods inside it, which are judged by themselves."""
    parts, at = [], m["at"][0]
    for a, b in inner:
        parts.append(plain[at:a])
        at = b
    return "".join([*parts, plain[at : m["at"][1]]])


def method_rules(code: str) -> list[tuple[str, str, str, int]]:
    """(rule, severity, method, line) for the rules on single methods."""
    out = []
    plain, found = blank(code), methods(code)
    inner: list[list[tuple[int, int]]] = [[] for _ in found]
    above: list[int] = []
    for i, m in enumerate(found):
        while above and found[above[-1]]["at"][1] <= m["at"][0]:
            above.pop()
        if above:
            inner[above[-1]].append(m["at"])
        above.append(i)
    for m, holes in zip(found, inner, strict=True):
        lines = m["end_line"] - m["start_line"] + 1
        body = own_body(m, holes, plain)
        checks = (
            ("LARGE-METHOD", "MEDIUM", lines > LINES),
            ("CYCLOMATIC", "MEDIUM", m["cyclomatic"] > BRANCHES),
            ("DEEP-NESTING", "MEDIUM", m["nesting"] > DEPTH),
            ("LONG-PARAM-LIST", "LOW", m["parameters"] > PARAMETERS),
        )
        out += [(rule, severity, m["name"], m["start_line"]) for rule, severity, hit in checks if hit]
        out += [(rule, severity, m["name"], m["start_line"]) for rule, severity, there, absent in BODY_RULES if there.search(body) and not (absent and absent.search(body))]
    return out


#: Comment lines in a row from which they may be code.
COMMENTED = 5
_POOL = re.compile(r"\b(?:private|protected|public|static|final|\s)+(?:ExecutorService|ScheduledExecutorService|ThreadPoolExecutor)\s+(\w+)\s*=\s*(?:Executors\.|new\s)")
_SINGLETON = re.compile(r"\b(?:private|public|protected)\s+static\s+(?!final\b|volatile\s+final\b)(?:volatile\s+)?[A-Z]\w*\s+(\w*[iI]nstance\w*)\s*(=[^;]*)?;")
_TRANSACTION = re.compile(r"@Transactional\b[^{};]*?\b(\w+)\s*\([^()]*\)\s*(?:throws\s+[\w., ]+)?\{")


def class_rules(code: str) -> list[tuple[str, str, str, int]]:
    """(rule, severity, name, line) for rules on a whole file."""
    plain, out = blank(code), []
    braces_of = braces(plain)
    at = lambda i: plain.count("\n", 0, i) + 1
    for m in _LOCKED.finditer(plain):
        if not re.search(rf"\bvolatile\b[^;]*\b{re.escape(m.group(1))}\b", plain):
            out.append(("DOUBLE-CHECK-NO-VOLATILE", "HIGH", m.group(1), at(m.start())))
    for m in _STATIC_MUTABLE.finditer(plain):
        out.append(("SHARED-MUTABLE", "HIGH", m.group(1), at(m.start())))
    if plain.count("\n") + 1 > 10 * LINES:
        out.append(("LARGE-CLASS", "LOW", "", 1))
    if not re.search(r"\.shutdown(?:Now)?\(", plain):
        out += [("THREADPOOL-NO-SHUTDOWN", "LOW", m.group(1), at(m.start(1))) for m in _POOL.finditer(plain)]
    for m in _SINGLETON.finditer(plain):
        # A holder that some method of the class sets anew after it was made.
        if len(re.findall(rf"(?<![\w.]){re.escape(m.group(1))}\s*=[^=]", plain)) > (m.group(2) is not None) + bool(_LOCKED.search(plain)):
            out.append(("GLOBAL-MUTABLE-SINGLETON", "MEDIUM", m.group(1), at(m.start(1))))
    for m in _TRANSACTION.finditer(plain):
        body = plain[m.end() : braces_of.get(m.end() - 1, len(plain))]
        if re.search(_REMOTE, body):
            out.append(("TX-REMOTE-CALL", "HIGH", m.group(1), at(m.start(1))))
    return out + [("COMMENTED-CODE", "LOW", "", line) for line in commented_code(code)]


def commented_code(code: str) -> list[int]:
    """First lines of runs of COMMENTED or more comment lines that read like code: with ``;`` and two of ``=``, ``(``, ``{``."""
    out, run, inside = [], [], False
    for n, line in enumerate([*code.split("\n"), ""], 1):
        s = line.strip()
        if inside or s.startswith(("//", "/*")):
            inside = (inside or s.startswith("/*")) and "*/" not in s
            run.append((n, s))
            continue
        text = "\n".join(x for _, x in run)
        if len(run) >= COMMENTED and ";" in text and sum(c in text for c in "=({") >= 2 and not text.startswith("/**"):
            out.append(run[0][0])
        run = []
    return out


def private_members(plain: str) -> list[tuple[str, str]]:
    """(kind, name) of private methods and private fields in blanked code."""
    out = [("method", m.group(1)) for m in re.finditer(r"\bprivate\s+(?:static\s+)?[\w<>\[\], ?]+?\s+(\w+)\s*\(", plain)]
    return out + [("field", m.group(1)) for m in _FIELD.finditer(plain) if "private" in m.group()]


def declared(code: str) -> list[tuple[str, str]]:
    """(kind, name) of private methods, private fields, interfaces and implementations in Java-like code."""
    plain = blank(code)
    out = private_members(plain)
    out += [("interface", m.group(1)) for m in re.finditer(r"\binterface\s+(\w+)", plain)]
    for m in re.finditer(r"\bimplements\s+([\w, <>]+)", plain):
        out += [("implements", x.strip().split("<")[0]) for x in m.group(1).split(",") if x.strip()]
    return out


def declarations(files: DataFrame, key: str, code: str) -> DataFrame:
    """(key, kind, name) of every file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, kind, name) for k, text in zip(batch["key"], batch["code"], strict=True) for kind, name in declared(text or "")]
            yield pd.DataFrame(rows, columns=["key", "kind", "name"])

    return files.select(F.col(key).alias("key"), F.col(code).alias("code")).mapInPandas(run, f"key {dict(files.dtypes)[key]}, kind string, name string")


_WORD = re.compile("[A-Za-z_][A-Za-z0-9_]*")


def unused(code: str) -> list[tuple[str, str]]:
    """(kind, name) of the private methods and fields whose name stands only once in the code."""
    members = dict.fromkeys(private_members(blank(code)))
    if not members:
        return []
    words = Counter(_WORD.findall(code))
    return [(kind, name) for kind, name in members if words[name] == 1]


def unused_members(files: DataFrame, key: str, code: str) -> DataFrame:
    """(key, kind, name): private methods and fields whose name stands only once in their own file; ``key`` is unique.

    A file's words are counted where the file is read: nothing is shuffled or broadcast, however many words there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, kind, name) for k, text in zip(batch["key"], batch["code"], strict=True) for kind, name in unused(text or "")]
            yield pd.DataFrame(rows, columns=["key", "kind", "name"])

    return files.select(F.col(key).alias("key"), F.col(code).alias("code")).mapInPandas(run, f"key {dict(files.dtypes)[key]}, kind string, name string")


def single_implementations(files: DataFrame, key: str, code: str) -> DataFrame:
    """(name, implementations): interfaces with at most one implementation in the whole corpus."""
    found = declarations(files, key, code)
    faces = found.where("kind = 'interface'").select("name").distinct()
    made = found.where("kind = 'implements'").groupBy("name").agg(F.count(F.lit(1)).alias("implementations"))
    return faces.join(made, "name", "left").select("name", F.coalesce("implementations", F.lit(0)).alias("implementations")).where("implementations <= 1")


def unused_names(declared_names: DataFrame, texts: DataFrame, name: str, text: str) -> DataFrame:
    """Declared names (configuration keys, dependencies) that no text holds, by an anti join on the texts' words."""
    words = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_@][A-Za-z0-9_.@/\-]*"), F.lit(0))).alias(name)).distinct()
    return declared_names.join(words, name, "left_anti")


def scan(files: DataFrame, key: str, code: str) -> DataFrame:
    """(key, method, start_line, lines, cyclomatic, nesting, parameters, rules) for each method of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["key"], batch["code"], strict=True):
                hits: dict[tuple[str, int], list[str]] = {}
                for rule, _, name, line in method_rules(text or ""):
                    hits.setdefault((name, line), []).append(rule)
                for m in methods(text or ""):
                    rows.append((k, m["name"], m["start_line"], m["end_line"] - m["start_line"] + 1, m["cyclomatic"], m["nesting"], m["parameters"], hits.get((m["name"], m["start_line"]), [])))
            yield pd.DataFrame(rows, columns=["key", "method", "start_line", "lines", "cyclomatic", "nesting", "parameters", "rules"])

    schema = f"key {dict(files.dtypes)[key]}, method string, start_line int, lines int, cyclomatic int, nesting int, parameters int, rules array<string>"
    return files.select(F.col(key).alias("key"), F.col(code).alias("code")).mapInPandas(run, schema)


def scan_classes(files: DataFrame, key: str, code: str) -> DataFrame:
    """(key, rule, severity, name, line) of the rules on whole files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *r) for k, text in zip(batch["key"], batch["code"], strict=True) for r in class_rules(text or "")]
            yield pd.DataFrame(rows, columns=["key", "rule", "severity", "name", "line"])

    return files.select(F.col(key).alias("key"), F.col(code).alias("code")).mapInPandas(run, f"key {dict(files.dtypes)[key]}, rule string, severity string, name string, line int")
