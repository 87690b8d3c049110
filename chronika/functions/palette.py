"""Colours of factions by their names: an ordered table of patterns, the first that a name holds gives the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in the order in which they are tried: a key and the patterns that a name must hold, all of them.
FRENCH = r"free french|french resistance|french army|\bfrance\b|grande arm[ée]e|french empire|napoleon"
COLOURS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("nazi-black", (r"nazi|wehrmacht|waffen[- ]?ss|kriegsmarine|luftwaffe|third reich|axis germany|german army group|panzer",)),
    ("imperial-japan", (r"imperial japan|japanese army|imperial japanese|empire of japan|kwantung|\bija\b|\bijn\b",)),
    ("fascist-italy", (r"fascist italy|kingdom of italy|italian fascist|regio esercito|mussolini",)),
    ("soviet-red", (r"soviet|red army|\bussr\b|stalin|warsaw pact",)),
    ("isis-black", (r"\bisis\b|\bisil\b|daesh|al[- ]qaeda|\baqi\b|zarqawi|mahdi army|islamic state|taliban|mujahid|insurgent|resistance(?!.*fr\.?)|militants?|jihadi|hamas|hezbollah|houthi|boko[- ]haram|al[- ]shabaab|wagner",)),
    ("nationalist-china", (r"nationalist china|kuomintang|\bkmt\b|chiang|republic of china",)),
    ("communist-china", (r"\bpla\b|people'?s liberation|communist china|red china|\bprc\b|mao",)),
    ("north-korea-red", (r"north korea|\bkpa\b|\bdprk\b|democratic people'?s",)),
    ("south-korea-blue", (r"south korea|\brok\b|republic of korea",)),
    ("north-vietnam-red", (r"north vietnam|\bnva\b|\bpavn\b|viet cong|\bvc\b|vietcong|viet[- ]?minh",)),
    ("south-vietnam-blue", (r"south vietnam|\barvn\b|republic of vietnam",)),
    ("ukraine-blue", (r"ukrainian|ukraine|\bzsu\b|\bafu\b|kyiv government",)),
    ("russia-modern-red", (r"russian federation|russian armed|wagner|donetsk|luhansk|\bvdv\b",)),
    ("israel-blue", (r"\bisraeli?\b|\bidf\b",)),
    ("iran-green", (r"\biran\b|iranian|\birgc\b|islamic revolutionary guard|islamic republic",)),
    ("confederate-gray", (r"\bconfederate|confederacy|\bcsa\b|johnny reb|army of northern virginia|army of tennessee|stonewall|lee'?s army",)),
    ("union-blue", (r"\bunion\b|federal army|army of the potomac|army of the cumberland|grant'?s|sherman'?s",)),
    ("royal-navy", (r"\bbef\b|british expeditionary|british empire|commonwealth|\braf\b|royal navy|royal army|\buk\b\s|\buk forces",)),
    ("us-blue", (r"united states|\bus army\b|\bus\.\s|\bu\.s\.|usmc|\bmarines\b|us navy|\busn\b|american expeditionary|allies\b|\baef\b",)),
    ("napoleonic-blue", (FRENCH, r"napoleon|grande arm[ée]e|french empire|first french|consulate")),
    ("free-french", (FRENCH,)),
    ("redcoat-red", (r"\bredcoats|king'?s army|crown forces|king george|british regulars",)),
    ("continental-blue", (r"continental army|continentals|patriots?\b|colonial militia",)),
    ("prussian-blue", (r"prussian|kingdom of prussia|\bprussia\b|frederick the great|german confederation|imperial german|kaiser",)),
    ("habsburg-white", (r"austrian empire|austria-?hungary|habsburg|holy roman|austrian army|imperial austrian",)),
    ("russian-green", (r"russian empire|tsarist|imperial russia|tsar\b|romanov",)),
    ("spanish-gold", (r"spanish empire|conquistador|tercio|\bspain\b|spanish army",)),
    ("ottoman-burgundy", (r"ottoman|janissary|sultanate of rum|sublime porte|seljuk",)),
    ("roman-crimson", (r"roman empire|roman republic|romans?\b|legion\b|legions\b|caesar|consul",)),
    ("carthage-purple", (r"carthage|carthaginian|hannibal|punic",)),
    ("persian-purple", (r"achaemenid|persian empire|sassanid|sasanian|persians|darius|xerxes",)),
    ("greek-slate", (r"\bgreeks?\b|hoplite|athen|sparta|macedon|alexander|seleucid|ptolem",)),
    ("mongol-amber", (r"mongol|\bkhan\b|genghis|kublai|golden horde",)),
    ("crusader-cream", (r"crusader|knights templar|hospitaller|teutonic|christian army",)),
    ("saracen-green", (r"saracen|ayyubid|caliphate|fatimid|mamluk|saladin|muslim army",)),
)


def colour_key(name: Column, explicit: Column | None = None, table: Sequence[tuple[str, Sequence[str]]] = COLOURS) -> Column:
    """The key that is given, else that of the first entry of the table whose patterns the name holds in any case; null without one."""
    low = F.lower(F.coalesce(name, F.lit("")))
    cases = []
    for key, patterns in table:
        holds = F.lit(True)
        for p in patterns:
            holds = holds & low.rlike(p)
        cases.append(F.when(holds, key))
    found = F.coalesce(*cases)
    return found if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), found)
