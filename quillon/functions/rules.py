"""Rules on short messages as Column expressions: small talk, signs of danger, titles against a term, follow-ups, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as tx

# Words of small talk by category; the words that decide a category, in order of precedence; ways to ask who is
# speaking; words that make a greeting of a message without a deciding word.
SMALL_TALK = {
    "salutation": ["salut", "bonjour", "bonsoir", "coucou", "hello", "hey", "yo", "bjr", "slt", "wesh", "rebonjour", "ca", "va", "comment", "vas", "allez", "tu", "vous"],
    "remerciement": ["merci", "mercii", "thanks", "remercie", "je", "te", "mille", "beaucoup", "bien", "infiniment", "bcp"],
    "acquiescement": ["ok", "okay", "oki", "dac", "d", "accord", "daccord", "oui", "ouais", "super", "parfait", "genial", "top", "cool", "nickel", "entendu", "compris", "bravo", "excellent", "tres", "impeccable", "ah", "oh", "bon", "bah", "ben", "c", "est", "note", "vu", "ca", "marche", "roule"],
    "aurevoir": ["au", "revoir", "bye", "ciao", "tchao", "a", "bientot", "plus", "tard", "demain", "bonne", "journee", "soiree", "nuit", "fin", "de", "la", "salut", "adieu"],
}
DECIDING = {
    "aurevoir": ["revoir", "bye", "ciao", "tchao", "bientot", "tard", "demain", "journee", "soiree", "nuit", "adieu"],
    "remerciement": ["merci", "mercii", "thanks", "remercie"],
    "salutation": ["salut", "bonjour", "bonsoir", "coucou", "hello", "hey", "yo", "bjr", "slt", "wesh", "rebonjour"],
    "acquiescement": ["ok", "okay", "oki", "dac", "accord", "daccord", "oui", "ouais", "super", "parfait", "genial", "top", "cool", "nickel", "entendu", "compris", "bravo", "excellent", "impeccable", "note", "vu", "marche", "roule"],
}
GREETING = ["va", "allez", "vas"]
SELF = [
    r"\bqui (es[ -]tu|etes[ -]vous|tu es|est[ -]ce que tu es)\b",
    r"\btu es qui\b",
    r"\b(comment (tu t appelles|t appelles[ -]tu|vous appelez[ -]vous)|quel est ton nom|c est quoi ton nom)\b",
    r"\b(tu sers|vous servez) a quoi\b",
    r"\ba quoi (tu sers|sers[ -]tu|servez[ -]vous)\b",
    r"\b(tu fais quoi|que fais[ -]tu|qu est ce que tu (fais|sais faire|peux faire)|tu peux faire quoi|tu sais faire quoi)\b",
    r"\b(parle[ -]moi de toi|presente[ -]toi|tu es un(e)? (robot|ia|intelligence|machine|humain))\b",
]
# Groups of words that together are a sign of danger, one of each group needed.
DANGER = [
    [["avale", "avalee", "bu", "bue", "ingere", "ingeree", "gobe", "gobee"], ["javel", "chlore", "produit", "medicament", "pilule", "comprime", "cachet", "essence", "petrole", "soude", "detergent", "lessive", "poison", "pesticide", "insecticide", "raticide", "acide", "ammoniaque", "antigel", "solvant", "debouche", "pile"]],
    [["tombe", "tombee", "chute", "chuter", "glisse", "glissee"], ["toit", "echelle", "arbre", "hauteur", "etage", "balcon", "falaise", "echafaudage", "fenetre", "mur", "grenier", "rocher"]],
    [["tombe", "tombee", "chute", "choc", "coup", "accident", "renverse", "renversee", "percute", "percutee", "ecrase", "ecrasee"], ["dos", "nuque", "cou", "colonne", "vertebre", "rachis"]],
    [["sent", "sens", "bouge", "bouger", "remue", "remuer"], ["plus"], ["jambe", "bras", "pied", "main"]],
]
ENDING = "(es|s|e|x)$"
# Phrases that are a sign of danger by themselves (normalised, apostrophes as blanks), and everyday injuries, on which a
# model's own flag is not believed.
SIGNS = [
    r"\b(perte de connaissance|perdu connaissance|evanoui|evanouie|s evanouit|inconscient|inconsciente|ne repond plus|ne se reveille pas|coma)\b",
    r"\b(respire (mal|plus|difficilement)|n arrive (pas|plus) a respirer|du mal a respirer|difficulte(s)? a respirer|detresse respiratoire|etouffe|suffoque|s etrangle|asphyxi)",
    r"\b(douleur|mal|serrement|oppression|poids)\b.{0,25}\b(poitrine|thorax|thoracique|sternum)\b",
    r"\b(saigne (beaucoup|abondamment|enormement|sans arret|toujours)|saignement (important|abondant|massif)|le sang (coule|gicle)|hemorragie|perd beaucoup de sang|n arrete pas de saigner|ne s arrete pas de saigner)",
    r"\bbrul(e|ee|ure|ures|ees)\b.{0,40}\b(etendue?s?|grave|graves|profondes?|au visage|aux yeux|tout le bras|toute la jambe|electrique|chimique|3e degre|troisieme degre|second degre)\b",
    r"\b(fracture ouverte|os (qui )?(sort|depasse|traverse la peau))\b",
    r"\b(convulsion|convulse|crise d epilepsie|epileptique)\b",
    r"\b(intoxication|intoxique|empoisonn|a avale (du|de la|des|un|une) (produit|javel|medicament|pilule|essence|soude)|overdose|surdose|monoxyde|champignon veneneux)",
    r"\b(noyade|se noie|s est noye|repeche de l eau)\b",
    r"\b(electrisation|electrocut|foudroy|pris le courant)\b",
    r"\b(suicide|me suicider|me tuer|en finir avec la vie)\b",
]
COMMON_INJURY = r"\b(coupe|coupure|egratignure|ecorchure|griffure|bleu|bosse|ampoule|echarde|piqure de moustique|petite brulure|mal de (tete|dos|ventre|gorge)|rhume|courbature|entorse legere)\b"
# The shape of a term; what a page of word definitions looks like, and how many of them make one.
TERM = r"^\p{L}[\p{L}\p{N}\s'’-]{1,39}$"
DEFINITION, DEFINITIONS = r"[\p{L}'’-]+, (?:adj|adv|f|m|n|v|nf|nm|pl)", 6


def spaced(text: Column) -> Column:
    """Normalised, with apostrophes and hyphens as blanks and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(tx.normalize(text), "['-]", " "), " +", " "))


def among(words: list[str]):
    """A test for arrays: whether an element is one of words."""
    return lambda x: x.isin(words)


def small_talk(text: Column) -> Column:
    """Category of a message that is about the speaker ('soi') or at most six words, all of them small talk; else null."""

    def of(words: Column) -> Column:
        every = sorted({x for group in SMALL_TALK.values() for x in group})
        found = F.lit(None).cast("string")
        for name, keys in [("salutation", GREETING), *reversed(DECIDING.items())]:
            found = F.when(F.exists(words, among(keys)), F.lit(name)).otherwise(found)
        return F.when(F.size(words).between(1, 6) & F.forall(words, among(every)), found)

    return F.when(spaced(text).rlike("|".join(f"(?:{x})" for x in SELF)), "soi").otherwise(of(tx.tokens(tx.normalize(text))))


def in_danger(words: Column, rules: list[list[list[str]]] | None = None) -> Column:
    """Whether, for some rule, each of its groups has a word of ``words``; endings of number and gender count as equal."""
    out, stems = F.lit(False), F.transform(words, lambda w: F.regexp_replace(w, ENDING, ""))
    for rule in rules or DANGER:
        every = F.lit(True)
        for group in rule:
            every &= F.exists(words, among(forms(group))) | F.exists(stems, among(forms(group)))
        out |= every
    return out


def forms(group: list[str]) -> list[str]:
    """The words of a group and their stems."""
    import re

    return sorted({*group, *(re.sub(ENDING, "", x) for x in group)})


def serious(text: Column, flag: Column) -> Column:
    """Whether a message shows a grave danger: a phrase of SIGNS, a word of each group of DANGER, or else a model's ``flag`` unless
    an everyday injury is named. A null text shows none; a null flag is none."""

    def of(t: Column) -> Column:
        signs = F.exists(F.array(*[F.lit(x) for x in SIGNS]), lambda x: F.rlike(t, x))
        return signs | in_danger(F.array_distinct(tx.tokens(t))) | (F.coalesce(flag, F.lit(False)) & ~t.rlike(COMMON_INJURY))

    return F.coalesce(tx.once(F.regexp_replace(F.replace(tx.normalize(text), F.lit("'"), F.lit(" ")), " +", " "), of), F.lit(False))


def glossary(text: Column) -> Column:
    """Whether a text is a page of word definitions: it has matches of DEFINITION six times or more."""
    return F.coalesce(F.regexp_count(text, F.lit(DEFINITION + "(?![A-Za-z0-9_])")) >= DEFINITIONS, F.lit(False))


def title_relation(title: Column, term: str) -> Column:
    """How a title relates to a normalised term: exact, commence (at most one more word), specialise, aucun."""

    def of(t: Column) -> Column:
        extra = F.size(F.filter(F.split(t, " "), lambda x: (x != "") & ~x.isin(term.split(" "))))
        return F.when(t == term, "exact").when(t.startswith(f"{term} ") & (extra <= 1), "commence").when(t.contains(term) & (t != ""), "specialise").otherwise("aucun")

    return tx.once(F.trim(F.regexp_replace(tx.normalize(F.coalesce(title, F.lit(""))), " +", " ")), of)


def same_word(a: Column, b: Column) -> Column:
    """Equal, or one of four letters or more begins the other, or both have five and share the first four."""
    n, m = F.length(a), F.length(b)
    return (a == b) | ((n >= 4) & b.startswith(a)) | ((m >= 4) & a.startswith(b)) | ((n >= 5) & (m >= 5) & (F.left(a, F.lit(4)) == F.left(b, F.lit(4))))


def term_of_question(term: Column, words: Column, asked: Column) -> Column:
    """A term that a model proposes, trimmed, if it has the shape of one and each of its useful ``words`` (one at least) is the same
    word as one ``asked``; else null."""
    plain = F.trim(F.coalesce(term, F.lit("")))
    backed = (F.size(words) > 0) & F.forall(words, lambda w: F.exists(asked, lambda a: same_word(a, w)))
    return F.when(plain.rlike(TERM) & backed, plain)


def positions(text: Column) -> Column:
    """For each character of the normalised text, the position from 0 of the character of text that it comes from."""
    each = F.transform(F.split(text, ""), lambda c, i: F.array_repeat(i, F.when(c.isin(list(tx.LIGATURES)), 2).when(c.rlike("^\\p{M}$"), 0).otherwise(1)))
    return F.when(F.length(text) > 0, F.flatten(each)).otherwise(F.expr("cast(array() as array<int>)"))
