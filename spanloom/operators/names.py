"""Person names: four anchored rules and one over a list of given names, walked word by word with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.spans import SPANS, find, let, one_of, span
from spanloom.operators.resolve import resolve_spans

#: Word classes of the rules.
CONNECTIVES = (
    "A An The This That These Those I You We They He She It My Your Our Their His Her Its And Or But If Then So As At "
    "By For From In Of On To With Please Thank Thanks Re Welcome"
).split()
FORMS_OF_ADDRESS = (
    "Sir Madam Sirs Team All Colleagues Customer Valued Hiring Manager Members Friend Friends Parent Guardian Resident "
    "Occupant Homeowner Applicant Candidate"
).split()
HONORIFICS = (
    "Mr Mrs Ms Miss Mx Dr Prof Professor Rev Reverend Hon Sen Senator Rep Representative Capt Captain Col Colonel Lt "
    "Lieutenant Sgt Sergeant Gen General Fr Father Sister Brother Judge Justice"
).split()
SUFFIXES = ["Jr", "Jr.", "Sr", "Sr.", "II", "III", "IV"]
DOCUMENT_WORDS = (
    "Inc LLC LLP Ltd Corp Corporation Company Co Group Partners Associates Bank Hospital Clinic Medical Center Centre "
    "University College School Department Office Foundation Institute Trust Services Systems Solutions Foods Motors "
    "Retail Holdings Industries Technologies Enterprises Brands Stores Markets Airlines Energy Capital Insurance "
    "Pharmaceuticals Media Press Publishing Studios Records Labs Software Consulting Logistics Manufacturing Realty "
    "Properties County City State Station Report Invoice Account Payment Total Date Name Patient Phone Email Address "
    "Signature Title Subject Section Page Table Figure Amount Balance Due Number No Summary Statement Details "
    "Information Form Type Status Code ID Period Notice Policy Plan Order Reference Ref"
).split()
MONTHS_AND_DAYS = (
    "January February March April May June July August September October November December "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday"
).split()
STREET_WORDS = (
    "Street St Avenue Ave Road Rd Boulevard Blvd Lane Ln Drive Dr Court Ct Way Place Pl Circle Cir Terrace Ter Parkway "
    "Pkwy Highway Hwy Trail Trl Square Sq"
).split()
NEVER_STARTS = [*CONNECTIVES, *FORMS_OF_ADDRESS, *HONORIFICS, *SUFFIXES]
ENDS = [*CONNECTIVES, *DOCUMENT_WORDS, *MONTHS_AND_DAYS, *STREET_WORDS]

#: Default given names: common ones, a parameter of person_names (a deployment passes its own, longer list).
GIVEN_NAMES = (
    "Aaron Adam Alan Albert Alexander Alice Amanda Amy Andrea Andrew Angela Anna Anthony Arthur Barbara Benjamin Betty "
    "Brian Carlos Carolyn Catherine Charles Charlotte Christina Christopher Cynthia Daniel David Deborah Dennis Diana "
    "Donald Donna Dorothy Edward Elizabeth Emily Emma Eric Eva Frances Gary George Gloria Gregory Hannah Harold Heather "
    "Helen Henry Isabel Jack Jacob James Jane Janet Jason Jean Jeffrey Jennifer Jessica Joan John Jonathan Jorge José "
    "Joseph Joshua Joyce Juan Judith Julia Julie Karen Katherine Kathleen Keith Kelly Kenneth Kevin Kimberly Larry Laura "
    "Lauren Linda Lisa Louis Lucas Luis Margaret Maria María Marie Marilyn Martha Martin Mary Matthew Megan Melissa "
    "Michael Michelle Nancy Nathan Nicholas Nicole Olivia Pamela Patricia Patrick Paul Peter Philip Rachel Raymond "
    "Rebecca Richard Robert Roger Ronald Ruth Ryan Samantha Samuel Sandra Sara Sarah Scott Sharon Sofia Stephanie "
    "Stephen Steven Susan Teresa Theresa Thomas Timothy Tyler Victoria Vincent Virginia Walter William Zachary"
).split()
#: Given names that are words too: not trusted at the start of a sentence.
AMBIGUOUS_NAMES = "Amber April Art August Autumn Bill Bob Carol Chase Christian Crystal Dawn Faith Frank Grace Grant Hope Jack Joy June Mark May Pat Ray Rich Rob Rose Summer Victor Will".split()

WORD = r"\p{Lu}[\p{Ll}'’]+(?:\p{Lu}[\p{Ll}'’]+)?"
TOKEN = rf"(?:Jr\.?|Sr\.?|I{{2,3}}|IV|{WORD}(?:-{WORD})*|\p{{Lu}}\.)"
PARTICLE = r"(?:(?:van|von|de|del|della|der|den|da|di|du|la|le|bin|ibn|al|el)[ \t]+)"
RUN = rf"{TOKEN}(?:[ \t]+{PARTICLE}*{TOKEN}){{0,4}}"
LAST_FIRST = rf"{WORD},[ \t]+{WORD}(?:[ \t]+\p{{Lu}}\.)?"
NOT_INSIDE = r"(?![\p{L}\p{M}'’-])"
ABBREVIATED = rf"(?U)(\b(?:Mr|Mrs|Ms|Mx|Dr|Prof|Rev|Hon|Sen|Rep|Capt|Col|Lt|Sgt|Gen|Fr)\.?[ \t]+)({RUN}){NOT_INSIDE}"
SPELLED_OUT = rf"(?U)(\b(?:Miss|Professor|Reverend|Senator|Representative|Captain|Colonel|Lieutenant|Sergeant|General|Father|Sister|Brother|Judge|Justice)[ \t]+)({RUN}){NOT_INSIDE}"
LABEL = (
    r"(?U)(\b(?iu:patient(?:[ \t]+name)?|name|attn|attention|employee|client|guarantor|insured|subscriber|physician|provider|signed|signature"
    rf"|prepared[ \t]+by|approved[ \t]+by|reviewed[ \t]+by|submitted[ \t]+by)[ \t]*[:\-–]\s*)({LAST_FIRST}|{RUN}){NOT_INSIDE}"
)
SALUTATION = (
    r"(?U)(\b(?iu:dear|sincerely|(?:best|kind|warm)[ \t]+regards|regards|yours[ \t]+(?:truly|sincerely|faithfully)|cordially|respectfully)"
    rf"(?:[ \t]*,\s*|\s+))({RUN}){NOT_INSIDE}"
)
LISTED = rf"(?U)(?<![\p{{L}}\p{{M}}'’-]){RUN}{NOT_INSIDE}"


#: Cheap tests of whole texts: what every match of a rule holds, beginning at a character that is rare in running text.
HAS_ABBREVIATED = r"[MDPRHSCLGF](?:rs?|s|x|rof|e[vpn]|on|apt|ol|t|gt)\.?[ \t]+\p{Lu}"
HAS_SPELLED_OUT = r"[MPRSCLGFBJ](?:iss|rofessor|everend|enator|epresentative|aptain|olonel|ieutenant|ergeant|eneral|ather|ister|rother|udge|ustice)[ \t]+\p{Lu}"
HAS_LABEL = r"(?U)[:\-–]\s*\p{Lu}"
HAS_SALUTATION = r"(?U)[RSYrsy](?=(?:[ \t]*,\s*|\s+)\p{Lu})(?<=(?i:dear|sincerely|regards|truly|faithfully|cordially|respectfully))"


def is_sentence_start(text: Column, index: Column) -> Column:
    """Only blanks lie between the index and the text's start, a line break, a terminator, a colon, or an opening mark."""
    before = F.rtrim(F.translate(F.substr(text, F.lit(1), index), "\t", " "))
    return (before == "") | before.rlike("[\\n\\r.!?:;\"“(\\[•\\-–—]\\z")


def _words(run: Column) -> Column:
    """The few words of a run, each with its place in it."""
    pieces = F.regexp_extract_all(run["text"], F.lit("[^ \t]+[ \t]*"), F.lit(0))
    start = lambda p, i: F.length(F.array_join(F.slice(p, F.lit(1), i), ""))
    word = lambda p, i, text: F.struct(start(p, i).alias("start"), F.length(text).alias("length"), F.rtrim(text, F.lit(",")).alias("word"), text.alias("text"))
    return let(pieces, lambda p: F.transform(p, lambda x, i: word(p, i, F.rtrim(x, F.lit(" \t")))))


def _end(words: Column, first: Column) -> Column:
    """Index of the first word after `first` that ends a name, or the number of words."""
    stops = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i > first) & one_of(F.get(words, i)["word"], ENDS))
    return F.coalesce(F.get(stops, F.lit(0)), F.size(words))


def _from_to(run: Column, words: Column, first: Column, end: Column, less=0) -> Column:
    a, z = F.get(words, first), F.get(words, end - 1)
    start, length = a["start"], z["start"] + z["length"] - a["start"] - less
    return span(run["start"] + start, length, F.substr(run["text"], start + 1, length))


def _anchored(runs: Column, least: int) -> Column:
    def judged(run: Column, words: Column, first: Column, end: Column) -> Column:
        cut = end < F.size(words)
        comma = cut & (end == 1) & first["text"].endswith(",")
        bad = one_of(first["word"], NEVER_STARTS) | (~comma & ((end < least) | ((end == 1) & cut)))
        return F.when(bad, None).when(comma, _from_to(run, words, F.lit(0), F.lit(1), 1)).otherwise(_from_to(run, words, F.lit(0), end))

    def one(run: Column) -> Column:
        return let(_words(run), lambda words: let(_end(words, F.lit(0)), lambda end: judged(run, words, F.get(words, F.lit(0)), end)))

    return F.array_compact(F.transform(runs, one))


def _listed(text: Column, runs: Column, names, ambiguous) -> Column:
    def judged(run: Column, words: Column, first: Column, end: Column) -> Column:
        a = F.get(words, first)
        doubtful = one_of(a["word"], ambiguous) & is_sentence_start(text, run["start"] + a["start"])
        return F.when(first.isNull() | doubtful | (end - first < 2), None).otherwise(_from_to(run, words, first, end))

    def one(run: Column) -> Column:
        known = lambda words: F.get(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: one_of(F.get(words, i)["word"], names)), F.lit(0))
        return let(_words(run), lambda words: let(known(words), lambda first: let(_end(words, first), lambda end: judged(run, words, first, end))))

    return F.array_compact(F.transform(runs, one))


def read_given_names(lines) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Lines of a name list -> (given_names, ambiguous_names) for person_names.

    One name a line; `#` starts a comment line, and names behind the line `## ambiguous` are words too. Repeats count once.
    """
    names: dict[str, None] = {}
    ambiguous: dict[str, None] = {}
    into = names
    for line in lines:
        name = line.strip()
        if name == "## ambiguous":
            into = ambiguous
        elif name and not name.startswith("#"):
            into[name] = None
    return tuple(names), tuple(ambiguous)


def person_names(text: Column, given_names=tuple(GIVEN_NAMES), ambiguous_names=tuple(AMBIGUOUS_NAMES)) -> Column:
    """Names without their titles and labels; where rules overlap the longest span stays."""
    names = [*given_names, *ambiguous_names]
    anchored = lambda p, test, n: _anchored(find(text, p, "$1", "$2", text.rlike(test)), n)
    # Texts without any listed word are not scanned for runs: one pass over their capitalised words against a hash set.
    has_name = F.arrays_overlap(F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{L}\p{M}]+"), F.lit(0)), F.split(F.lit("\x1f".join(names)), "\x1f"))
    runs = F.filter(find(text, LISTED, only_if=has_name), lambda r: F.exists(F.split(r["text"], "[ \t]+"), lambda w: one_of(w, names)))
    every = F.concat(anchored(ABBREVIATED, HAS_ABBREVIATED, 1), anchored(SPELLED_OUT, HAS_SPELLED_OUT, 2), anchored(LABEL, HAS_LABEL, 1), anchored(SALUTATION, HAS_SALUTATION, 1), _listed(text, runs, names, ambiguous_names))
    return resolve_spans(every.cast(SPANS))
