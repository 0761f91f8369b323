"""Which words carry a meaning: closed lists of normalised words, and rules on words and titles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as tx

# Normalised words that are never the subject of a question: function words, common verbs, numbers, adverbs, words of
# time, persons.
FUNCTION = """a ai au aux avec c ca ce ceci cela ces cet cette ceux celle celles celui chez comme comment combien d dans de des
    donc du elle elles en entre et eux il ils j je l la le les leur leurs lui m ma mais me mes moi mon n ne ni nos notre nous on ou par
    pas pour pourquoi quand que quel quelle quelles quels qui quoi s sa se ses si son sous sur t ta te tes toi ton tu un une vers vos
    votre vous y alors quelque quelques chaque aucun aucune rien personne""".split()
VERBS = """suis es est sommes etes sont etais etait etions etiez etaient serai sera serons seront serait ete etre
    ai as avons avez ont avais avait avions aviez avaient aurai aura aurait eu eue avoir
    vais vas va allons allez vont aller alle allee fais fait faisons faites font faire faisait
    peux peut pouvons pouvez peuvent pouvoir pourrait veux veut voulons voulez veulent vouloir voudrais
    dois doit devons devez doivent devoir sais sait savons savez savent savoir vois voit voir mets met mettre
    prends prend prendre dis dit dire viens vient venir faut falloir semble sembler reste rester devient devenir
    donne donner trouve trouver passe passer arrive arriver
    manger mange mangee boire bu bois boit dormir dort tomber tombe tombee tombes marcher marche courir cours court
    respirer respire soigner soigne guerir aider aide garder garde utiliser utilise savoir chercher cherche
    appeler appelle attendre attend sortir sort rentrer entrer ouvrir fermer laver lave couper coupe mettre casser
    avaler avale avalee toucher touche sentir sent bouger bouge vivre vit mourir meurt meurs perdre perd perdu
    rendre rend gagner porter porte laisser laisse tenir tient penser pense croire crois devenir devient""".split()
NUMBERS = """zero un une deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize vingt
    trente quarante cinquante soixante septante huitante nonante cent cents mille million millions milliard premier premiere
    second seconde deuxieme troisieme quatrieme cinquieme dixieme moitie quart tiers demi demie douzaine dizaine centaine""".split()
ADVERBS = """tres trop beaucoup peu plus moins encore deja toujours jamais souvent parfois depuis aussi tout tous toute
    toutes bien mal vite ici la aujourd aujourdhui hier demain maintenant presque surtout vraiment environ assez tellement tant
    partout dehors dedans ensemble seulement plutot enfin puis ensuite avant apres pendant bientot longtemps oui non autant ainsi""".split()
TIMES = """jour jours journee journees semaine semaines mois an ans annee annees heure heures minute minutes seconde
    secondes matin matinee soir soiree nuit nuits lundi mardi mercredi jeudi vendredi samedi dimanche weekend fois instant""".split()
PERSONS = """bebe bebes enfant enfants fils fille filles garcon garcons mere pere femme femmes mari homme hommes frere
    freres soeur soeurs parent parents grandmere grandpere papa maman papy mamie personne personnes gens voisin voisine voisins
    ami amie amis copain copine famille monsieur madame""".split()
# Words without a subject of their own, from articles to catch-all nouns and adjectives.
EMPTY = """a ai as au aux avec avoir c ca ce ceci cela ces cet cette ceux celle celles celui
    combien comme comment d dans de des donc du elle elles en est et etais etait etre
    eux faire fais fait faut il ils j je l la le les leur lui m ma mais me mes
    moi mon n ne nos notre nous on ont ou par pas peut plus pour pourquoi quand que
    quel quelle quelles quels qui quoi sa sais sait se ses si son sont sur t ta te
    tes toi ton tu un une vos votre vous y alors aussi bien encore meme tout toute
    cas facon maniere chose truc moment fois type sorte genre exemple besoin probleme
    fort forte forts fortes grand grande petit petite gros grosse bon bonne mauvais mauvaise
    nouveau nouvelle vieux vieille beau belle chaud chaude froid froide rapide lent lente
    grave leger legere simple difficile important importante urgent urgente meilleur pire vrai faux""".split()
# Sections that hold what one usually looks for.
GENERAL = ["premiers soins", "traitement", "que faire", "symptomes", "prevention", "diagnostic"]

NEVER = sorted({*FUNCTION, *VERBS, *NUMBERS, *ADVERBS, *TIMES, *PERSONS})
NO_START = sorted({*FUNCTION, *VERBS, *NUMBERS, *ADVERBS})
ENDING = "(es|s|x)$"


def may_be_noun(word: Column) -> Column:
    """Three letters or more, nothing else, and in none of the lists."""
    return word.rlike("^\\p{L}{3,}$") & ~word.isin(NEVER)


def carries(word: Column) -> Column:
    """A possible noun or a number."""
    return may_be_noun(word) | word.rlike("^[0-9]+$")


def nominal_title(words: Column) -> Column:
    """Whether a title's words can be the subject of a question: four letters in all, a first word that may begin one, a noun."""
    first = F.coalesce(F.get(words, F.lit(0)).isin(NO_START), F.lit(True))
    return (F.length(F.array_join(words, "")) >= 4) & ~first & F.exists(words, may_be_noun)


def words_of(text: Column, brackets: bool = True) -> Column:
    """The words of a text as the phrase matching compares them: normalised, what is no letter or digit separates; without
    ``brackets`` what stands in round ones goes."""
    plain = tx.normalize(F.coalesce(text, F.lit("")))
    return tx.tokens(plain if brackets else F.regexp_replace(plain, "\\([^)]*\\)", " "))


def useful_words(text: Column) -> Column:
    """Words of three letters or more that are not empty ones, in order, repeats kept."""
    return F.filter(words_of(text), lambda x: (F.length(x) >= 3) & ~x.isin(EMPTY))


def useful_stems(text: Column) -> Column:
    """Useful words, or all where there is none, without an ending of number."""
    pick = lambda w: F.when(F.size(w[0]) > 0, w[0]).otherwise(w[1])
    return F.transform(tx.once(F.array(useful_words(text), words_of(text)), pick), lambda x: F.regexp_replace(x, ENDING, ""))


def useful_keys(keywords: Column) -> Column:
    """Keywords as one line of the words among them that may be nouns."""
    return F.array_join(F.filter(words_of(F.array_join(keywords, " ")), may_be_noun), " ")


def general_section(section: Column) -> Column:
    """Whether a section's heading is one of GENERAL or begins with one as whole words."""
    of = lambda s: s.isin(GENERAL) | s.rlike(f"^(?:{'|'.join(GENERAL)}) ")
    return tx.once(F.trim(F.regexp_replace(tx.normalize(F.coalesce(section, F.lit(""))), " +", " ")), of)
