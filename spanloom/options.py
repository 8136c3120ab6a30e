"""What to look for and what to put in its place; parsing and validation of requests."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from spanloom.catalog import BY_NAME, KINDS, parse_category, parse_kind

ALL = 15
DEFAULT_PLACEHOLDER = "[{0}]"


def format_placeholder(template: str, label: str) -> str:
    """Composite format with one argument: {0} is the label, doubled braces are literal; anything else is an error."""
    out, i = [], 0
    while i < len(template):
        two = template[i : i + 2]
        if two in ("{{", "}}"):
            out.append(two[0])
            i += 2
        elif m := re.match(r"\{0(?:,(-?\d+))?(?::[^{}]*)?\}", template[i:]):
            width = int(m[1] or 0)
            out.append(label.rjust(width) if width >= 0 else label.ljust(-width))
            i += m.end()
        elif template[i] in "{}":
            raise ValueError(f"placeholder format is invalid at {i}")
        else:
            out.append(template[i])
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class RedactionOptions:
    categories: int = ALL
    excluded: frozenset[str] = field(default_factory=frozenset)
    custom_terms: tuple[str, ...] = ()
    terms_case_sensitive: bool = False
    placeholder: str = DEFAULT_PLACEHOLDER

    @property
    def terms(self) -> tuple[str, ...]:
        return tuple(t for t in (t.strip() for t in self.custom_terms) if t)

    def effective_kinds(self) -> tuple[str, ...]:
        """Kinds of the categories without the excluded, plus CustomTerm when there are terms (an exclusion can't stop those)."""
        chosen = [k.name for k in KINDS if k.categories & self.categories and k.name not in self.excluded]
        return tuple(chosen + ["CustomTerm"] if self.terms else chosen)

    def placeholder_for(self, kind: str) -> str:
        return format_placeholder(self.placeholder, BY_NAME[kind].label)

    def without(self, kinds) -> RedactionOptions:
        return replace(self, excluded=self.excluded | frozenset(kinds))


def parse_request(categories=(), excluded=(), terms="", case_sensitive: bool = False, placeholder: str | None = None) -> tuple[RedactionOptions | None, dict[str, str]]:
    """Options and all errors by field. Names are split at commas and semicolons, terms at line breaks only."""
    errors: dict[str, str] = {}
    names = lambda xs: [n.strip() for x in ([xs] if isinstance(xs, str) else xs) for n in re.split(r"[,;]", x) if n.strip()]
    mask = 0
    for n in names(categories):
        found = parse_category(n)
        if found is None:
            errors["categories"] = f"Unknown category '{n}'."
        else:
            mask |= found
    out = set()
    for n in names(excluded):
        kind = parse_kind(n)
        if kind is None:
            errors["excludedKinds"] = f"Unknown kind '{n}'."
        else:
            out.add(kind)
    own = tuple(t.strip() for x in ([terms] if isinstance(terms, str) else terms) for t in re.split(r"\r\n|\r|\n", x) if t.strip())
    if not mask and not own and "categories" not in errors:
        errors["categories"] = "Select a category or give a custom term."
    shape = placeholder if placeholder and placeholder.strip() else DEFAULT_PLACEHOLDER
    try:
        format_placeholder(shape, "X")
    except ValueError as e:
        errors["placeholderFormat"] = str(e)
    return (None if errors else RedactionOptions(mask, frozenset(out), own, case_sensitive, shape)), errors


def bind_form(fields) -> dict:
    """(name, value) pairs of a form -> arguments of parse_request.

    Repeated fields stay lists and other fields are ignored; the flag is true only where its one value reads `true`; a
    repeated placeholder is joined by commas. Null values are left out.
    """
    got: dict[str, list[str]] = {}
    for name, value in fields:
        if value is not None:
            got.setdefault(name.lower(), []).append(value)
    shape, flag = got.get("placeholderformat"), ",".join(got.get("customtermsarecasesensitive", []))
    return {
        "categories": got.get("categories", []),
        "excluded": got.get("excludedkinds", []),
        "terms": got.get("customterms", []),
        "case_sensitive": flag.strip().lower() == "true",
        "placeholder": None if shape is None else ",".join(shape),
    }
