"""What a path is: generated, a test, a document, a configuration, a rule; module names; kinds of references in a line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of generated files; a parameter everywhere.
GENERATED = (r"(^|/)(generated|gen|build|dist|target)/", r"\.(pb|generated)\.[a-z]+$", r"\.min\.(js|css)$")
TESTS = r"(?i)(^|/)(test|tests|__tests__|spec|specs|testing)(/|$)|(Test|Tests|Spec|IT)\.(java|js|jsx|ts|tsx|vue)$|\.(test|spec)\.(js|jsx|ts|tsx|vue)$"
DOCUMENTS = r"(?i)\.(md|txt|rst|adoc|adr)$"
CONFIGS = r"(?i)(^|/)(pom\.xml|build\.gradle(\.kts)?|package\.json|tsconfig[A-Za-z0-9_.\-]*\.json|(application|bootstrap)[A-Za-z0-9_.\-]*\.(ya?ml|properties)|[A-Za-z0-9_.\-]+\.config\.(js|ts|mjs|cjs))$"
RULES = r"(?i)(^|/)(rules|docs|requirements|specs)/|\.feature$|(^|/)(README|REQUIREMENTS|SPEC|CONTRIBUTING)\.md$"
#: Endings of a module's name that tell its role.
ROLES = "(?i)(Impl|Service|Controller|Manager|Handler|Repository|Dao|DTO|VO|Entity|Mapper)$"


def is_generated(path: Column, patterns: Sequence[str] = GENERATED) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(p)
    return out


def path_kind(path: Column) -> Column:
    """test, config, rule, document or source; the first that holds."""
    return F.when(path.rlike(TESTS), "test").when(path.rlike(CONFIGS), "config").when(path.rlike(RULES), "rule").when(path.rlike(DOCUMENTS), "document").otherwise("source")


def module_name(name: Column) -> Column:
    """A file's or class's name without extension, role and separators, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?i)\.[a-z0-9]+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, ROLES, ""), r"[_\-\s.]", ""))


def reference_kind(line: Column, name: str, xml: bool = False) -> Column:
    """How a line refers to a name: xml, annotation, import, reflection, call or text."""
    if xml:
        return F.when(line.rlike(rf"\b(?:id|ref|bean|class|namespace)[ \t]*=[ \t]*[\"'][^\"']*{name}"), "xml").otherwise("text")
    return (
        F.when(line.rlike(rf"^[ \t]*@[A-Za-z0-9_]*{name}\b"), "annotation")
        .when(line.rlike(r"^[ \t]*(?:import|export|from|require|using|package)\b"), "import")
        .when(line.rlike(r"\b(?:forName|getMethod|getDeclaredMethod|loadClass|getBean|ServiceLoader|import|require|context)\b"), "reflection")
        .when(line.rlike(rf"\b{name}[ \t]*\("), "call")
        .otherwise("text")
    )
