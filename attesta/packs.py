"""Rule packs as plain data: which patterns and codes stand for which term.

A pack is small and fixed by its author (tens of patterns), so it travels inside
the plan as literals. Patterns use the syntax that Java and Python share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


# A claim's place in the order of claims keeps so many bits for its rule.
RULE_BITS = 12
MAX_RULES = 1 << RULE_BITS


@dataclass(frozen=True)
class Rule:
    capability: str
    patterns: tuple[str, ...]
    codes: tuple[str, ...] = ()


@dataclass(frozen=True)
class RulePack:
    """Rules in priority order; ``suppress`` holds (winner, loser) pairs per element."""

    rules: tuple[Rule, ...]
    cue_before: str
    cue_after: str
    suppress: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        terms = self.taxonomy
        if len(set(terms)) != len(terms):
            raise ValueError("a term may have one rule only")
        if len(terms) > MAX_RULES:
            raise ValueError(f"a pack may have {MAX_RULES} rules")

    @property
    def taxonomy(self) -> tuple[str, ...]:
        return tuple(r.capability for r in self.rules)

    @property
    def patterns(self) -> tuple[str, ...]:
        return tuple(p for r in self.rules for p in r.patterns)

    def rule(self, capability: str) -> Rule:
        return next(r for r in self.rules if r.capability == capability)

    def winners_over(self, capability: str) -> tuple[Rule, ...]:
        return tuple(self.rule(w) for w, loser in self.suppress if loser == capability)

    def code_rows(self, spark: SparkSession) -> DataFrame:
        """One row per code; a code listed by two rules belongs to the first."""
        owner: dict[str, tuple[str, int]] = {}
        for i, r in enumerate(self.rules):
            for c in r.codes:
                owner.setdefault(c, (r.capability, i))
        return spark.createDataFrame(
            [(c, cap, i) for c, (cap, i) in owner.items()],
            "code string, capability string, rule_ord int",
        )


@dataclass(frozen=True)
class IndicatorRule:
    key: str
    label: str
    kind: str
    patterns: tuple[str, ...]
    is_caveat: bool = False


@dataclass(frozen=True)
class IndicatorPack:
    rules: tuple[IndicatorRule, ...]
    cue_before: str
    cue_after: str

    @property
    def caveat_keys(self) -> tuple[str, ...]:
        return tuple(r.key for r in self.rules if r.is_caveat)

    @property
    def filterable_keys(self) -> tuple[str, ...]:
        return tuple(r.key for r in self.rules if not r.is_caveat)


# ---------------------------------------------------------------------------
# The medical taxonomy, its patterns, codes and cue phrases.
# ---------------------------------------------------------------------------

CARE_CUE_BEFORE = (
    r"\b(?:no|not|without|lack of|absence of|unavailable|do(?:es)? not have|doesn'?t have|"
    r"does not offer|not equipped|not provided|in-?house\s+(?:no|none)|"
    r"proposed|upcoming|non[- ]?functional)\b"
)

CARE_CUE_AFTER = (
    r"\b(?:cases? (?:are )?referred to|patients? (?:are )?referred to|refer(?:s|red)? out|"
    r"transferred to|managed elsewhere|treated elsewhere|sent to|not available|"
    r"not (?:offered|provided|in[- ]?house)|elsewhere|"
    r"under construction|under renovation|not (?:yet )?operational|"
    r"yet to be|non[- ]?functional|temporarily closed|being (?:built|constructed|set up))\b"
)

CARE_PACK = RulePack(
    rules=(
        Rule("icu",
             (r"\bICU\b", r"\bintensive care\b", r"\bcritical care\b",
              r"\bcardiac care unit\b|\bCCU\b"),
             ("criticalCareMedicine",)),
        Rule("nicu",
             (r"\bNICU\b", r"\bneonatal ICU\b", r"\bneonatal intensive care\b", r"\bneonatology\b"),
             ("neonatologyPerinatalMedicine",)),
        Rule("maternity",
             (r"\bmaternity\b", r"\bobstetric", r"\blabour ward\b|\blabor ward\b",
              r"\bdelivery suite\b", r"\bbirthing\b", r"\binstitutional birth"),
             ("gynecologyAndObstetrics", "obstetricsAndGynecology")),
        Rule("emergency",
             (r"\bemergency department\b", r"\b24/?7 emergency\b", r"\b24[- ]hour emergency\b",
              r"\bcasualty\b", r"\bemergency care\b", r"\bER\b", r"\btrauma & emergency\b"),
             ("emergencyMedicine",)),
        Rule("oncology",
             (r"\boncology\b", r"\bchemotherap", r"\bradiation therap",
              r"\bcancer (treatment|care|centre|center)\b", r"\bmedical oncology\b",
              r"\bsurgical oncology\b"),
             ("medicalOncology", "hematologyOncology", "radiationOncology", "surgicalOncology",
              "pediatricOncology", "gynecologicOncology")),
        Rule("trauma",
             (r"\btrauma surgery\b", r"\bpolytrauma\b", r"\btrauma (centre|center)\b",
              r"\btrauma care\b", r"\borthopedic trauma\b"),
             ("traumaSurgery", "orthopedicTrauma")),
        Rule("surgery",
             (r"\boperation theat", r"\boperating room\b", r"\bmodular ot\b", r"\bsurgical suite\b",
              r"\blaparoscop", r"\bgeneral surgery\b"),
             ("generalSurgery",)),
        Rule("cardiology",
             (r"\bcardiology\b", r"\bcardiac\b", r"\bcath(?:eterization|eterisation)? lab\b",
              r"\becho ?cardiograph", r"\bangiograph", r"\bangioplast"),
             ("cardiology", "interventionalCardiology")),
        Rule("dialysis",
             (r"\bdialysis\b", r"\bh[ae]modialysis\b", r"\brenal replacement\b")),
        Rule("radiology",
             (r"\bradiology\b", r"\bMRI\b", r"\bCT scan\b", r"\bx-?ray\b", r"\bultrasound\b",
              r"\bsonograph", r"\bPET scan\b", r"\bdiagnostic imaging\b"),
             ("radiology", "diagnosticRadiology")),
        Rule("pediatrics",
             (r"\bp[ae]diatric", r"\bchild health\b"),
             ("pediatrics", "paediatrics")),
        Rule("ophthalmology",
             (r"\bophthalmolog", r"\beye care\b", r"\bcataract\b", r"\bophthalmic\b"),
             ("ophthalmology",)),
    ),
    cue_before=CARE_CUE_BEFORE,
    cue_after=CARE_CUE_AFTER,
    suppress=(("nicu", "icu"),),
)

# Keys, labels and patterns of the indicators.
CARE_INDICATORS = IndicatorPack(
    rules=(
        IndicatorRule("temporarily_closed", "Temporarily closed", "operational",
                      (r"\btemporarily closed\b", r"\bcurrently closed\b",
                       r"\bclosed (?:temporarily|for|due to|until)\b", r"\bshut down\b"),
                      is_caveat=True),
        IndicatorRule("under_construction", "Service under construction / not yet operational",
                      "operational",
                      (r"\bunder construction\b", r"\bunder renovation\b",
                       r"\bnot yet operational\b",
                       r"\byet to be (?:commissioned|operational|functional)\b",
                       r"\bnon[- ]?functional\b", r"\bbeing (?:built|constructed|set up)\b"),
                      is_caveat=True),
        IndicatorRule("open_24_7", "Open 24/7", "operational",
                      (r"\b24\s*[x/]\s*7\b", r"\b24[- ]?hours?\b", r"\bround[- ]the[- ]clock\b",
                       r"\bopen 24\b", r"\b24/7\b")),
        IndicatorRule("wheelchair_access", "Wheelchair / disabled access", "access",
                      (r"\bwheel\s?chair\b", r"\bdifferently[- ]abled\b",
                       r"\bdisabled[- ]friendly\b", r"\bdivyang\b", r"\bramp access\b",
                       r"\bbarrier[- ]free\b", r"\bwheelchair[- ]accessible\b")),
        IndicatorRule("ambulance", "Ambulance service", "access",
                      (r"\bambulance\b", r"\bair ambulance\b", r"\b108 service\b")),
        IndicatorRule("blood_bank", "Blood bank", "access",
                      (r"\bblood bank\b", r"\bblood storage unit\b")),
        IndicatorRule("pharmacy", "Pharmacy / medicines on site", "access",
                      (r"\bpharmacy\b", r"\bjan aushadhi\b", r"\bin-?house pharmacy\b",
                       r"\bmedicines? available\b", r"\bdispensary\b")),
        IndicatorRule("cashless_insurance", "Cashless / insurance accepted", "access",
                      (r"\bcashless\b", r"\bayushman\b", r"\bempanel", r"\bnetwork hospital\b",
                       r"\binsurance (?:network|accepted|facility|scheme)\b", r"\bPMJAY\b")),
    ),
    cue_before=CARE_CUE_BEFORE,
    cue_after=CARE_CUE_AFTER,
)

# Substring cues of the literal-needle evidence finder.
NEEDLE_CUES = (
    "no ", "not ", "without", "lack of", "absence of", "unavailable",
    "do not have", "doesn't have", "does not offer", "not equipped",
    "referred elsewhere", "refer out", "not provided",
)

# The canonical state and territory names.
CANONICAL_STATES = (
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat",
    "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh",
    "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan",
    "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal",
    "Andaman And Nicobar Islands", "Chandigarh", "Dadra And Nagar Haveli And Daman And Diu",
    "Delhi", "Jammu And Kashmir", "Ladakh", "Lakshadweep", "Puducherry",
)

# Tokens that display names keep in capitals, and words kept small.
NAME_ACRONYMS = (
    "icu", "nicu", "picu", "ccu", "er", "ot", "ir", "ent", "ivf", "mri", "ct", "pet", "ecg", "egg",
    "ekg", "ecmo", "iit", "iim", "aiims", "kims", "scb", "ram", "sgpgi", "amri", "max", "kgmu",
    "jipmer", "nimhans", "ihbas", "tmh", "kem", "lhmc", "rml", "abvims", "iiitm", "ngo", "phc",
    "chc", "hsc", "ub", "iv",
)
NAME_SMALL_WORDS = ("and", "of", "the", "for", "in", "on", "at", "to", "a", "an")

# ---------------------------------------------------------------------------
# A second pack, for running the same operators over general prose tables.
# ---------------------------------------------------------------------------

NOTICE_CUE_BEFORE = r"\b(?:no|not|without|nicht|sans|sin|or|by)\b"
NOTICE_CUE_AFTER = r"\b(?:NC|version 3|not|from|with)\b|\$\$\$|###"

NOTICE_PACK = RulePack(
    rules=(
        Rule("permissive", (r"\bapache license\b", r"\bmit license\b"), ("src3",)),
        Rule("copyleft", (r"\bgeneral public license\b",), ("src5", "src3")),
        Rule("noncommercial", (r"\bCC BY-NC\b",)),
        Rule("contact",
             (r"\b[a-z0-9.]+@[a-z0-9]+\.example\.(com|net|org)\b", r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}\b"),
             ("src7",)),
        Rule("network", (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",), ("src11",)),
        Rule("card", (r"\b\d{13,19}\b",)),
        Rule("common", (r"\bthe\b", r"\bof the\b|\bin the\b"), ("es",)),
    ),
    cue_before=NOTICE_CUE_BEFORE,
    cue_after=NOTICE_CUE_AFTER,
    suppress=(("permissive", "common"), ("contact", "common")),
)

# The same pack a revision later: fewer cards, other words for contact, one more term, stricter cues.
REVISED_NOTICE_PACK = RulePack(
    rules=(
        *(r for r in NOTICE_PACK.rules if r.capability not in ("contact", "card")),
        Rule("contact", (r"\b[a-z0-9.]+@[a-z0-9]+\.example\.(com|net|org)\b",), ("src7",)),
        Rule("card", (r"\b4\d{12,18}\b",)),
        Rule("article", (r"\bthis\b",)),
    ),
    cue_before=NOTICE_CUE_BEFORE,
    cue_after=NOTICE_CUE_AFTER,
    suppress=NOTICE_PACK.suppress,
)

NOTICE_INDICATORS = IndicatorPack(
    rules=(
        IndicatorRule("restricted", "Use is restricted", "operational",
                      (r"\bCC BY-NC\b", r"\ball rights reserved\b"), is_caveat=True),
        IndicatorRule("secret", "Holds a token", "operational", (r"\btoken\b", r"\bpassword\b"),
                      is_caveat=True),
        IndicatorRule("reachable", "Reachable", "access",
                      (r"\b[a-z0-9.]+@[a-z0-9]+\.example\.(?:com|net|org)\b",
                       r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}\b")),
        IndicatorRule("licensed", "Licence named", "access", (r"\blicensed\b", r"\blicense\b")),
        IndicatorRule("english", "English wording", "access", (r"\bwith the\b", r"\band\b", r"\bthe\b")),
    ),
    cue_before=NOTICE_CUE_BEFORE,
    cue_after=NOTICE_CUE_AFTER,
)
