"""The twelve feature flags in free text, in four languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodefuse.functions.text import confidence, mention

# fixed values: how sure a mention of a feature is, and the patterns that mention it, by language
MENTIONS: dict[str, tuple[float, dict[str, list[str]]]] = {
    "balcony": (0.80, {
        "de": [r"\bBalkon(?:e|en|s)?\b", r"\bTerrasse[ns]?\b", r"\bLoggia[s]?\b", r"\bSitzplatz\b"],
        "fr": [r"\bbalcons?\b", r"\bterrasses?\b", r"\bloggias?\b"],
        "it": [r"\bbalcon[ei]\b", r"\bterrazz[aoei]\b", r"\blogge?\b"],
        "en": [r"\bbalcon(?:y|ies)\b", r"\bterraces?\b", r"\bpatios?\b"],
    }),
    "elevator": (0.85, {
        "de": [r"\bLift\w*\b", r"\bAufzug\w*\b", r"\bFahrstuhl\w*\b", r"\bPersonenlift\w*\b"],
        "fr": [r"\bascenseurs?\b"],
        "it": [r"\bascensor[ei]\b"],
        "en": [r"\belevators?\b", r"\blifts?\b"],
    }),
    "parking": (0.75, {
        "de": [r"\bParkplatz\b", r"\bParkpl[äa]tze\b", r"\bAussenparkplatz\b", r"\bAutoeinstellhalle\b", r"\bCarport\b"],
        "fr": [r"\bplace\s+de\s+parc\b", r"\bparkings?\b", r"\bplaces?\s+de\s+parking\b", r"\bcarports?\b"],
        "it": [r"\bposto\s+auto\b", r"\bparchegg[io]\b"],
        "en": [r"\bparkings?\b", r"\bparking\s+spaces?\b", r"\bcarports?\b"],
    }),
    "garage": (0.80, {
        "de": [r"\b(?:Einzel|Doppel|Tief)?garage\b", r"\bEinstellhalle\b"],
        "fr": [r"\bgarages?\b", r"\bbox\s+(?:individuel|ferm[ée])\b"],
        "it": [r"\bbox\s+auto\b", r"\bbox\s+chiuso\b", r"\bautorimesse?\b"],
        "en": [r"\bgarages?\b"],
    }),
    "fireplace": (0.85, {
        "de": [r"\bChemin[ée]e\b", r"\bKamin\b", r"\bSchwedenofen\b", r"\bHolzofen\b"],
        "fr": [r"\bchemin[ée]es?\b", r"\bpo[êe]les?\s+(?:à\s+bois|su[ée]dois)?\b"],
        "it": [r"\bcaminett[oi]\b", r"\bcamin[oi]\b"],
        "en": [r"\bfireplaces?\b", r"\bwood-?burning\s+stoves?\b"],
    }),
    "child_friendly": (0.70, {
        "de": [r"\bkinderfreundlich\b", r"\bfamilienfreundlich\b", r"\bfamili[eä]r\b", r"\bideal\s+f[üu]r\s+Familien\b"],
        "fr": [r"\bfamilial(?:e|es|aux)?\b", r"\bid[ée]al\s+pour\s+(?:les\s+)?familles\b", r"\badapt[ée]\s+aux\s+enfants\b"],
        "it": [r"\badatt[oa]\s+(?:ai\s+)?bambini\b", r"\bideale\s+per\s+famiglie\b", r"\bfamiliar[ei]\b"],
        "en": [r"\bchild[- ]friendly\b", r"\bfamily[- ]friendly\b", r"\bideal\s+for\s+families\b"],
    }),
    "pets_allowed": (0.75, {
        "de": [r"\bHaustiere?\s+(?:sind\s+)?erlaubt\b", r"\bHaustiere?\s+willkommen\b", r"\btierfreundlich\b", r"\bHunde?\s+(?:sind\s+)?erlaubt\b", r"\bKatzen?\s+(?:sind\s+)?erlaubt\b"],
        "fr": [r"\banimaux\s+(?:accept[ée]s|admis|autoris[ée]s|bienvenus)\b"],
        "it": [r"\banimali\s+(?:ammessi|accettati|autorizzati|benvenuti)\b"],
        "en": [r"\bpets\s+(?:allowed|welcome|ok)\b", r"\bpet[- ]friendly\b"],
    }),
    "temporary": (0.80, {
        "de": [r"\bbefristet\b", r"\bZwischenmiete\b", r"\bUntermiete\s+tempor[äa]r\b", r"\bvor[üu]bergehend\b", r"\bkurzfristig\b"],
        "fr": [r"\btemporaires?\b", r"\bsous[- ]location\b", r"\bcourt\s+terme\b"],
        "it": [r"\btemporane[oa]\b", r"\baffitto\s+breve\b", r"\bbreve\s+periodo\b"],
        "en": [r"\btemporary\b", r"\bshort[- ]term\b", r"\bsublets?\b"],
    }),
    "new_build": (0.85, {
        "de": [r"\bNeubau(?:wohnung)?\b", r"\bErstvermietung\b", r"\bErstbezug\b"],
        "fr": [r"\bconstruction\s+neuve\b", r"\bpremi[èe]re\s+location\b", r"\bneu[fs]?\b"],
        "it": [r"\bnuov[oa]\s+costruzione\b", r"\bprima\s+locazione\b"],
        "en": [r"\bnew[- ]builds?\b", r"\bnewly[- ]built\b", r"\bbrand[- ]new\b"],
    }),
    "wheelchair_accessible": (0.85, {
        "de": [r"\brollstuhl(?:g[äa]ngig|gerecht)\b", r"\bbarrierefrei\b", r"\bbehindertengerecht\b"],
        "fr": [r"\baccessible\s+(?:aux\s+)?(?:handicap[ée]s|fauteuils?\s+roulants?)\b", r"\bsans\s+barri[èe]res?\b"],
        "it": [r"\baccessibile\s+(?:ai\s+)?disabili\b", r"\bsenza\s+barriere\b"],
        "en": [r"\bwheelchair[- ]accessible\b", r"\bbarrier[- ]free\b"],
    }),
    "private_laundry": (0.75, {
        "de": [r"\beigene\s+Waschmaschine\b", r"\bWaschmaschine\s+in\s+der\s+Wohnung\b", r"\bWaschturm\b", r"\beigener\s+Trockner\b"],
        "fr": [r"\bmachine\s+à\s+laver\s+priv[ée]e?\b", r"\blave[- ]linge\s+dans\s+le\s+logement\b"],
        "it": [r"\blavatrice\s+privata\b", r"\blavatrice\s+in\s+appartamento\b"],
        "en": [r"\bin[- ]unit\s+laundry\b", r"\bprivate\s+washing\s+machines?\b"],
    }),
    "minergie_certified": (0.95, {
        "de": [r"\bMinergie(?:-[APE])?(?:-[APE])?\b", r"\bMinergie-zertifiziert\b"],
        "fr": [r"\bMinergie(?:-[APE])?(?:-[APE])?\b", r"\bcertifi[ée]e?\s+Minergie\b"],
        "it": [r"\bMinergie(?:-[APE])?(?:-[APE])?\b", r"\bcertificat[oa]\s+Minergie\b"],
        "en": [r"\bMinergie(?:-[APE])?(?:-[APE])?\b", r"\bMinergie[- ]certified\b"],
    }),
}

#: A denied feature is a finding, but an unsure one.
DENIED_MOST, DENIED_SHARE = 0.5, 0.6


def feature(name: str, text: Column, lang: Column) -> Column:
    """struct(filled, source, confidence, raw) of a feature that a text mentions or denies; null where it does neither."""
    base, patterns = MENTIONS[name]
    hit = mention(text, patterns, lang)

    def found(h: Column) -> Column:
        sure = F.when(h["negated"], min(DENIED_MOST, base * DENIED_SHARE)).otherwise(confidence(base, h["lang"] == lang, F.lit(False)))
        raw = F.when(h["negated"], F.concat(F.lit("NEG:"), h["value"])).otherwise(h["value"])
        return F.when(h.isNotNull(), F.struct(F.when(h["negated"], "0").otherwise("1").alias("filled"), F.concat(F.lit("text_regex_"), h["lang"]).alias("source"), sure.alias("confidence"), raw.alias("raw")))

    return F.get(F.transform(F.array(hit), found), F.lit(0))
