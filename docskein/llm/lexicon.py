"""Words of several languages for the features of broken pairs, and sentences from which refusals are made to train on.

FUNCTION_WORDS are common short words, for telling languages apart. CLASSES name what a word is about when somebody declines: themselves,
negation, ability, saying, knowing, the sources and so on; the classifier sees a sentence as these classes and learns which
combinations decline, so that it isn't bound to the sentences it was trained on. None of the sentences stands in the test tables.
"""

from __future__ import annotations

FUNCTION_WORDS = {
    "en": "the of and to in is are for by that when which before after only all other each no not was with from or if how what why where does do who as this it its be has have had were once can could may must should would will between than i you we they at on an but so then there their these those into about over under am my me our your",
    "de": "der die das und in ist sind für von den dem des nicht ein eine einen einem einer wird werden wurde zu mit auf wenn nur nach bei im aus als über wie was warum wo wann wer welche welcher welches wozu an am oder durch kann darf muss soll ich wir sie er es sich zum zur falls bevor auch noch nur um unter zwischen kein keine bis damit dass bin habe mir mich mein",
    "fr": "le la les des et du de un une est sont pour par dans sur avec si que qui ne pas plus à en au aux ce cette ces se sa son leur quand lorsque dès quel quelle pourquoi comment où ou selon l d qu je il elle nous vous ils été être avoir ont peut doit sans entre mais donc après avant suis ai peux mon ma",
    "es": "el la los las de y en un una es son para por con si que no se del al lo su sus como cuando cada según también qué cuál cómo dónde está están sin más han ha hay solo este esta estos sobre entre pero porque antes después desde hasta ser puede debe soy estoy tengo puedo mi",
    "pt": "o a os as de e em um uma é são para por com se que não do da dos das no na nos nas ao à pelo pela como quando cada até também qual onde está estão sem mais foi há este esta sobre entre mas porque antes depois desde ser pode deve seu sua sou estou tenho posso meu",
    "it": "il lo la i gli le di e in un una è sono per con se che non del della dei delle al alla come quando ogni anche quale dove senza più dopo questo questa da nel nella si ma o perché prima tra essere può deve sono ho posso mio",
    "nl": "de het een en van in is zijn voor met op niet dat die als er aan door bij naar om ook wordt worden alleen elke welke waarom hoe waar of te uit over na ik kan maar dan deze dit moet mag",
    "sv": "och att det som en ett är den av för på med inte om har till de från men var när hur varför vad vilken vilka eller efter innan mellan bara också kan ska måste blir detta denna",
    "pl": "i w na z do nie się jest są to że dla od przez jak co gdzie kiedy który która które czy lub oraz po przed tylko też może musi być tym tego ta ten",
}
LANGUAGE_OF: dict[str, tuple[str, ...]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in set(_words.split()):
        LANGUAGE_OF[_word] = (*LANGUAGE_OF.get(_word, ()), _language)

#: Words, and beginnings of words (with *), of each class; a word may be of several.
CLASSES = {
    "self": "i me my we us our myself assistant* ai bot ich mir mich wir uns mein* unser* ki assistent* je j moi mon ma mes nous notre ia yo mi mis nos nosotros eu meu minha mim puedo sé tengo estoy soy siento conozco encuentro dispongo podemos posso sei tenho estou sou sinto conheço encontro disponho lamento",
    "not": "not no t never none nothing neither nor cannot unable without lack* insufficient* impossible unavailable missing unknown nicht kein* nie niemals nichts weder ohne unmöglich unbekannt fehlt fehlen mangel* außerstande ne n pas aucun* rien jamais sans ni impossible inconnu* incapable ningun* ningún nada nunca sin imposible tampoco incapaz não nao nenhum* nenhuma sem nem impossível desconhec* insuffis* insuficient*",
    "able": "can could cannot able unable possible impossible allow* permit* authori* position capable kann könn* darf dürf* möglich* unmöglich* erlaub* befugt imstande außerstande lage peux peut pouv* puis possib* impossib* permis autoris* mesure puedo puede* pod* posible imposible autoriz* capaz posso possível impossível",
    "say": "answer* say tell explain* help* assist* comment* discuss* provid* give giving respond* reply speculat* guess* advis* elaborat* address* offer* clarif* determin* conclu* antwort* beantwort* sagen helfen weiterhelf* erklär* erläuter* geben äußer* mitteil* beurteil* spekulier* répon* dire aider expliqu* donner fourni* prononcer spécul* responder respond* decir ayudar explicar dar ofrecer proporcion* coment* contest* ajudar dizer fornec* esclarec* opinar especul*",
    "know": "know* aware familiar understand sure certain find found locate access see recall weiß wissen kenne kennen bekannt finde* gefunden zugriff zugang einblick sais connais* savoir trouv* accès sé saber conoz* conoc* encontr* hall* acceso sei conhec* acesso",
    "info": "information* info detail* answer answers response evidence knowledge fact facts clue* indication* basis auskunft angabe* einzelheit* hinweis* anhaltspunkt* grundlage antwort renseignement* détail* élément* réponse información dato datos detalle* respuesta indicio* informaç* detalhe* resposta dados elementos training wissen connaissance* conocimiento* conhecimento*",
    "source": "context* document* source* passage* text texts material* excerpt* snippet* corpus policy policies guideline* kontext* dokument* quelle* unterlage* textstelle* auszug* auszüge* richtlini* contexte* extrait* texte* politique* directive* contexto* fuente* fragmento* pasaje* texto* política* fonte* trecho* diretri*",
    "hold": "contain* mention* includ* cover* provid* specif* stat* support* exist* available unavailable present address* describ* enthält enthalten erwähn* nenn* nennt hergeb* hergeben vorlieg* liegen liegt verfügbar* beschreib* contien* mentionn* évoqu* fourni* figur* disponible* trait* contien* mencion* inclu* aparec* menciona* contém disponíve* aborda* consta*",
    "sorry": "sorry apolog* unfortunately regret* afraid pardon leider bedau* entschuldig* leid désolé* malheureusement regrett* excus* siento lament* perdón disculp* desculp* infelizmente sinto",
    "decline": "declin* refus* refrain* rather abstain* prefer ablehn* lehne verweiger* lieber verzicht* déclin* abstien* abstenir préfèr* prefier* rechaz* abstener* abstengo abster* recus* prefir* uncomfortable comfortable",
    "beyond": "beyond outside scope remit außerhalb hinaus rahmen dehors delà cadre fuera ámbito alcance fora além âmbito",
    "enough": "enough sufficient* insufficient* adequate genug genüg* ausreich* assez suffis* insuffis* suficient* insuficient*",
    "asked": "question* request* query topic subject* inquiry that this frage* anfrage* thema dazu davon darüber demande* sujet* cela pregunta* consulta* solicitud* tema eso pergunta* pedido* assunto* isso",
    "refer": "please contact* consult* refer ask team expert* bitte wenden fragen veuillez adress* demand* favor consulte* pregunte* contacte* pergunte*",
    "but": "but however still nevertheless though although yet aber jedoch dennoch trotzdem allerdings mais cependant toutefois pourtant néanmoins pero embargo obstante mas porém contudo entanto",
    "nothing": "none null nan nil na empty blank undefined void nothing missing tbd todo placeholder unavailable leer nichts vide vacío vazio rien nada",
}
_EXACT: dict[str, set[str]] = {}
_STEMS: dict[str, set[str]] = {}
for _name, _words in CLASSES.items():
    for _word in _words.split():
        (_STEMS if _word.endswith("*") else _EXACT).setdefault(_word.rstrip("*"), set()).add(_name)
_LONGEST = max(map(len, _STEMS))


def classes_of(word: str) -> tuple[str, ...]:
    """The classes of a lower-case word."""
    found = set(_EXACT.get(word, ()))
    for n in range(3, min(len(word), _LONGEST) + 1):
        found |= _STEMS.get(word[:n], set())
    return tuple(sorted(found))


#: Sentences that decline; {x} becomes an identifier or a word of the question.
REFUSALS = {
    "en": (
        "My apologies, but this is something I am not able to assist you with.", "I apologize, but I can't answer that.", "That question goes beyond my knowledge.", "This topic lies outside the scope of the supplied material.",
        "The provided passages say nothing about {x}.", "Nothing in the supplied excerpts addresses {x}.", "I could not find {x} anywhere in the sources.", "I have no knowledge of {x}.", "I am not familiar with {x}, so I can't say.",
        "I would prefer not to answer.", "I refuse to answer this request.", "I do not feel comfortable discussing {x}.", "My guidelines do not allow me to talk about {x}.", "No details about {x} are available to me.",
        "I don't have enough context to respond.", "The text lacks the information that would be needed to explain {x}.", "It isn't possible for me to determine this.", "We regret that we cannot provide an answer.",
        "As a large language model, I am not able to look at {x}.", "I don't have any information on {x}.", "The answer to this is not known to me.", "Please consult an expert, as I can't advise you on {x}.", "I won't comment on {x}.",
        "Sorry, that is not something I can discuss.", "I'm not sure and would only be guessing.", "The available material is insufficient to answer the question.", "I cannot see {x}, so I can't tell.", "Regrettably, no source describes {x}.",
        "This is not covered by my training data.", "I must refrain from commenting on {x}.", "Your query cannot be answered from the excerpts at hand.", "I do not have permission to reveal anything about {x}.", "I can neither confirm nor explain this.",
    ),
    "de": (
        "Ich bedaure, aber hier kann ich nicht weiterhelfen.", "Das übersteigt leider mein Wissen.", "Zu {x} ist mir nichts bekannt.", "Die vorliegenden Auszüge sagen nichts über {x} aus.", "Eine Antwort ist mir nicht möglich.",
        "Ich finde in den Quellen keine Angaben zu {x}.", "Ich möchte mich lieber nicht zu {x} äußern.", "Die Unterlagen reichen nicht aus, um das zu beantworten.", "Ich lehne es ab, {x} zu erläutern.", "Meine Richtlinien erlauben mir keine Aussage über {x}.",
        "Dieses Thema liegt außerhalb dessen, was ich erklären darf.", "Verzeihung, darauf habe ich keine Antwort.", "Als KI kann ich {x} nicht einsehen.",
    ),
    "fr": (
        "Je regrette, mais je ne suis pas en mesure de répondre.", "Cela dépasse mes connaissances.", "Les extraits fournis ne disent rien de {x}.", "Je ne trouve aucune indication sur {x} dans les sources.", "Je préfère ne pas me prononcer sur {x}.",
        "Je n'ai pas connaissance de {x}.", "Il m'est impossible de répondre à votre demande.", "Les sources ne suffisent pas pour expliquer {x}.", "Mes directives ne me permettent pas de parler de {x}.", "Ce sujet est en dehors de mon domaine, je dois décliner.", "Excusez-moi, je n'ai pas la réponse.",
    ),
    "es": (
        "Lamento no poder ayudarle con esta consulta.", "Eso está fuera de mi conocimiento.", "Los fragmentos proporcionados no dicen nada de {x}.", "No encuentro ningún dato sobre {x} en las fuentes.", "Prefiero no opinar sobre {x}.",
        "No conozco {x}, por lo que no puedo explicarlo.", "Me resulta imposible contestar.", "Las fuentes no bastan para responder.", "Mis directrices no me permiten hablar de {x}.", "Disculpe, no tengo la respuesta.", "Debo abstenerme de comentar {x}.",
    ),
    "pt": (
        "Lamento, mas não consigo responder.", "Isso está além do meu conhecimento.", "Os trechos fornecidos não dizem nada sobre {x}.", "Não encontro nenhuma indicação de {x} nas fontes.", "Prefiro não opinar sobre {x}.",
        "Não conheço {x}, por isso não posso explicar.", "É impossível para mim responder ao pedido.", "As fontes não são suficientes para responder.", "As minhas diretrizes não permitem falar de {x}.", "Peço desculpa, não tenho a resposta.",
    ),
}
#: Sentences that hold back and go on to answer.
RESERVATIONS = {
    "en": ("Apologies in advance if this is too brief.", "I can't vouch for each case, but the main path is simple.", "Although the sources are silent on {x}, the code is plain.", "I have not seen {x}, yet the call order follows from the code.", "Not everything about {x} is known, still the rest can be said:", "Regrettably this takes a few lines."),
    "de": ("Bitte entschuldigen Sie die Kürze, das Wichtigste steht hier.", "Zu {x} fehlen Angaben, der übrige Weg ist aber eindeutig.", "Ich kenne nicht jeden Fall, im Kern gilt jedoch dies:"),
    "fr": ("Pardon pour ce détour, voici l'essentiel.", "Je ne connais pas tous les cas, mais le principe est simple.", "Les sources restent muettes sur {x}, pourtant le code est clair."),
    "es": ("Perdón por el rodeo, aquí va lo esencial.", "No conozco todos los casos, pero el principio es sencillo.", "Las fuentes callan sobre {x}, aunque el código es claro."),
    "pt": ("Perdão pelo desvio, eis o essencial.", "Não conheço todos os casos, mas o princípio é simples.", "As fontes calam sobre {x}, mas o código é claro."),
}
#: What is written where there is no answer; brackets, quotes and case are added at random.
PLACEHOLDERS = (
    "none", "null", "nan", "nil", "n/a", "na", "empty", "blank", "missing", "undefined", "void", "nothing", "tbd", "todo", "no reply", "no text", "nothing returned", "no value", "reply:", "response:", "answer:", "answer", "output:", "placeholder", "not given",
    "keine Antwort", "leer", "nichts", "sin contestar", "vacío", "nada", "vide", "rien", "vazio", "sem texto", "k.A.",
)
WRAPPERS = ("{}", "{}", "[{}]", "<{}>", "({})", '"{}"', "'{}'", "{}.", "*{}*", "-{}-", "`{}`", "```\n{}\n```", " {} ", "{{{}}}")
