"""The pattern catalogues and the scored recognizers. Results depend on each of them as it stands."""

from __future__ import annotations

from dataclasses import dataclass

#: Label -> patterns, in the order in which they are tried.
BASE: dict[str, list[str]] = {
    "IBAN": [r"\bCH\s?\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?[\d]{1,2}\b"],
    "EMAIL": [r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"],
    "PHONE": [
        r"\+41[\s\-]?\d{2}[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}",
        r"\b0\d{2}[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b",
        r"\b0\d{2}\s\d{3}\s\d{2}\s\d{2}\b",
    ],
    "DATE": [
        r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b",
        r"\b\d{1,2}\.\s?(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\s?\d{2,4}\b",
        r"\b(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\s\d{4}\b",
        r"\bQ[1-4]\s?\d{4}\b",
        r"\b(?:19|20)\d{2}\b",
    ],
    "MONEY": [
        r"\b(?:CHF|EUR|USD|GBP)\s?[\d'.,]+(?:\s?(?:Mio|Mrd|k|K|Tsd)\.?)?(?!\w)",
        r"\b\d[\d'.,]*\s?(?:CHF|EUR|USD|GBP)(?:\s?(?:Mio|Mrd|k|K|Tsd)\.?)?(?!\w)",
        r"\b(?:CHF|EUR|USD|GBP)\b",
        r"\b\d+(?:['.,]\d+)?[kK]\b",
    ],
}

#: The service tries neither the third phone pattern nor a currency alone.
SERVICE_SKIPS = [r"\b0\d{2}\s\d{3}\s\d{2}\s\d{2}\b", r"\b(?:CHF|EUR|USD|GBP)\b"]

#: What the test tables hold beyond the base catalogue.
EXTENDED: dict[str, list[str]] = {
    "PHONE": [r"\+1 \(\d{3}\) \d{3}-\d{4}"],
    "IP": [r"\b(?:\d{1,3}\.){3}\d{1,3}\b"],
    "CARD": [r"\b\d{16}\b"],
    "SECRET": [r"\btoken = \"[^\"]+\""],
}


@dataclass(frozen=True)
class Recognizer:
    entity: str
    #: (pattern, score); patterns are read in any case.
    patterns: tuple[tuple[str, float], ...]
    context: tuple[str, ...] = ()


#: In the order in which they are registered.
REGISTRY = [
    Recognizer("EMAIL_ADDRESS", ((r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.9),), ("E-Mail", "Mail", "Email", "Mailadresse", "per Mail")),
    Recognizer("IBAN_CODE", ((r"\b[A-Z]{2}\d{2}[\s]?[\dA-Z]{4}[\s]?(?:[\dA-Z]{4}[\s]?){2,7}[\dA-Z]{1,4}\b", 0.85),), ("IBAN", "Konto", "Kontonummer", "Bankverbindung")),
    Recognizer("URL", ((r"\bhttps?://[^\s]+\b", 0.6),)),
    Recognizer(
        "PHONE_NUMBER",
        ((r"\+\d{1,3}[\s\-]?\d[\d\s\-]{6,14}\d", 0.7), (r"\b0\d{2}[\s]?\d{3}[\s]?\d{2}[\s]?\d{2}\b", 0.6)),
        ("Telefon", "Tel", "Natel", "Handy", "Mobilnummer", "Telefonnummer", "telefonisch", "anrufen", "erreichbar", "Nummer"),
    ),
    Recognizer("CH_IBAN", ((r"\bCH\d{2}[\s]?(?:\d{4}[\s]?){4,5}\d{1,4}\b", 0.9),), ("IBAN", "Konto", "Kontonummer", "Bankkonto", "Bankverbindung")),
    Recognizer(
        "CH_PHONE",
        ((r"\+41[\s]?\d{2}[\s]?\d{3}[\s]?\d{2}[\s]?\d{2}", 0.85), (r"\b0\d{2}[\s]?\d{3}[\s]?\d{2}[\s]?\d{2}\b", 0.7)),
        ("Telefon", "Tel", "Natel", "Handy", "Mobilnummer", "Telefonnummer", "telefonisch", "anrufen", "erreichbar"),
    ),
    Recognizer(
        "MONEY",
        ((r"\b(?:CHF|EUR|USD|GBP)\s*\d[\d'.,\s]*(?:Mio\.?|Mrd\.?|k)?(?!\w)", 0.85), (r"\b\d[\d'.,\s]*\s*(?:CHF|EUR|USD|GBP|Franken|Euro)\b", 0.8)),
        ("Betrag", "Summe", "Volumen", "Umsatz", "Gewinn", "EBITDA", "Investition", "Finanzierung", "Hypothek", "Kredit", "überweisen", "zahlen", "Zahlung", "kosten", "Preis", "Wert"),
    ),
    Recognizer(
        "DATE_TIME",
        (
            (r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b", 0.9),
            (r"\b\d{1,2}\.?\s*(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\s*\d{2,4}\b", 0.85),
            (r"\b(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\s+\d{4}\b", 0.7),
            (r"\b(?:19|20)\d{2}\b", 0.6),
            (r"\b(?:Ende\s+(?:Monat|Woche|Jahr)|nächste[rns]?\s+(?:Woche|Monat|Jahr)|letzten?\s+(?:Woche|Monat|Jahr))\b", 0.6),
            (r"\b\d+\s*(?:Monate[n]?|Jahre[n]?|Wochen|Tage[n]?)\b", 0.5),
        ),
        ("Datum", "am", "bis", "vom", "seit", "ab", "per", "Termin", "Frist", "Laufzeit", "Auszahlung"),
    ),
    Recognizer(
        "JOB_TITLE",
        (
            (
                r"\b(?:CEO|CFO|COO|CTO|CIO|CMO|Geschäftsführer(?:in)?|Geschäftsleitungsmitglied|Leiter(?:in)?\s+\w+|Direktor(?:in)?|Verwaltungsrat(?:spräsident(?:in)?)?|"
                r"Inhaber(?:in)?|Buchhalter(?:in)?|Projektleiter(?:in)?|Analyst(?:in)?|Berater(?:in)?|Architekt(?:in)?|Ingenieur(?:in)?|Spezialist(?:in)?|"
                r"Sachbearbeiter(?:in)?|Assistentin|Assistent|Treuhänder(?:in)?|Export\s*Manager(?:in)?|(?:FX|TEF|Treasury)[- ]?Spezialist(?:in)?)\b",
                0.7,
            ),
        ),
        ("als", "Position", "Funktion", "Rolle", "tätig", "arbeitet", "der", "die", "designierte", "zuständig"),
    ),
    Recognizer(
        "AGE",
        ((r"\b\d{1,3}\s*(?:Jahre?\s*(?:alt)?|jährig(?:e[rns]?)?|-jährig(?:e[rns]?)?)\b", 0.8), (r"\b(?:Alter|Alter:)\s*\d{1,3}\b", 0.8)),
        ("alt", "Alter", "geboren", "Jahrgang", "jährig"),
    ),
    Recognizer(
        "NATIONALITY",
        (
            (
                r"\b(?:deutsch(?:e[rns]?)?|französisch(?:e[rns]?)?|italienisch(?:e[rns]?)?|österreichisch(?:e[rns]?)?|schweizerisch(?:e[rns]?)?|Schweizer(?:in)?|"
                r"britisch(?:e[rns]?)?|amerikanisch(?:e[rns]?)?|chinesisch(?:e[rns]?)?|japanisch(?:e[rns]?)?|türkisch(?:e[rns]?)?|spanisch(?:e[rns]?)?|"
                r"portugiesisch(?:e[rns]?)?|niederländisch(?:e[rns]?)?|belgisch(?:e[rns]?)?|polnisch(?:e[rns]?)?|russisch(?:e[rns]?)?|koreanisch(?:e[rns]?)?|"
                r"indisch(?:e[rns]?)?|brasilianisch(?:e[rns]?)?|chilenisch(?:e[rns]?)?|europäisch(?:e[rns]?)?)\b",
                0.6,
            ),
        ),
        ("Staatsbürger", "Staatsangehörigkeit", "Nationalität", "Bürger", "Pass", "Herkunft"),
    ),
    Recognizer(
        "EDUCATION",
        (
            (r"\b(?:ETH(?:\s*(?:Zürich|Zuerich))?|HSG|EPFL|Universität\s+\w+|Hochschule\s+\w+|Fachhochschule\s+\w+)\b", 0.7),
            (
                r"\b(?:MBA|PhD|Dr\.|ETH-Absolvent(?:in)?|HSG-Absolvent(?:in)?|EPFL-Absolvent(?:in)?|Hochschulabschluss|Hochschulabsolvent(?:in)?|"
                r"(?:Holzbau|Maschinen|Elektro|Bau)-?Ingenieur(?:in)?\s+(?:FH|ETH|HF))\b",
                0.7,
            ),
        ),
        ("studiert", "Abschluss", "Absolvent", "Studium", "gelernt", "ausgebildet", "Ausbildung"),
    ),
]
