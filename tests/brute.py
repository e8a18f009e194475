"""The claim, evidence and trust rules once more, in plain Python, for small fixtures."""

from __future__ import annotations

import hashlib
import re

from attesta.packs import RulePack


def _id(*parts: str) -> str:
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def _hit(pattern: str, text: str):
    return re.search(pattern, text, re.I)


def claims_of(row: dict, pack: RulePack) -> dict[str, dict]:
    kinds = {"capabilities": ("capability", 0.85), "specialties": ("specialty", 0.8),
             "procedures": ("procedure", 0.75), "equipment": ("equipment", 0.75)}
    out: dict[str, dict] = {}
    for field, (kind, conf) in kinds.items():
        for text in filter(None, row.get(field) or []):
            fired = []
            for rule in pack.rules:
                if field == "specialties":
                    if text.strip() in rule.codes:
                        fired.append((rule.capability, text))
                        break
                    continue
                m = next(filter(None, (_hit(p, text) for p in rule.patterns)), None)
                if m:
                    fired.append((rule.capability, text[max(0, m.start() - 100):m.end() + 100].strip()))
            names = {c for c, _ in fired}
            lost = {x for w, x in pack.suppress if w in names and field != "specialties"}
            for cap, span in fired:
                if cap not in lost:
                    key = _id(row["facility_id"], kind, cap, text)
                    out.setdefault(key, {"capability": cap, "conf": conf, "span": span, "field": field})
    return out


def evidence_of(row: dict, claims: dict[str, dict], pack: RulePack) -> dict[str, dict]:
    out: dict[str, dict] = {}
    for cap in dict.fromkeys(c["capability"] for c in claims.values()):
        mine = [(k, c) for k, c in claims.items() if c["capability"] == cap]
        primary = max(mine, key=lambda kc: kc[1]["conf"])[0]
        texts = [("description", row.get("description"))]
        for field in ("capabilities", "procedures", "equipment", "specialties"):
            texts += [(field, t) for t in row.get(field) or []]
        for field, text in texts:
            for p in pack.rule(cap).patterns:
                for m in re.finditer(p, text or "", re.I):
                    quote = text[max(0, m.start() - 100):m.end() + 100].strip()
                    denied = _hit(pack.cue_before, text[max(0, m.start() - 50):m.start()]) or _hit(
                        pack.cue_after, text[m.end():m.end() + 80]
                    )
                    out.setdefault(
                        _id(primary, quote[:64]),
                        {"claim": primary, "capability": cap, "snippet": quote, "field": field,
                         "polarity": "contradicts" if denied else "supports"},
                    )
    return out


def trust_of(row: dict, pack: RulePack) -> dict[str, tuple]:
    claims = claims_of(row, pack)
    found = evidence_of(row, claims, pack).values()
    out = {}
    for cap in {c["capability"] for c in claims.values()}:
        mine = [c for c in claims.values() if c["capability"] == cap]
        s = sum(e["capability"] == cap and e["polarity"] == "supports" for e in found)
        c = sum(e["capability"] == cap and e["polarity"] == "contradicts" for e in found)
        base = max(0.0, max(x["conf"] for x in mine) - 0.2)
        score = min(1.0, max(0.0, base + min(0.3, 0.08 * s) - min(0.8, 0.3 * c)))
        if c and s <= c:
            status = "contradicted"
        else:
            status = "verified" if not c and s >= 2 and score >= 0.75 else "unclear"
        out[cap] = (len(mine), s, c, round(score, 6), status)
    return out
