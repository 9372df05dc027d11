"""Whether an answer declines and answers nothing: a classifier of sentences.

A sentence is described by the ideas its words stand for (``IDEAS``: the speaker, a negation, ability, answering,
declining, rules, limits, regret, redirection and so on, in English, German, French and Spanish), by pairs of ideas and
by how near a negation stands to ability or answering. A softmax regression over these tells three classes: declining,
courtesy around it (regret, thanks, redirection) and content; it is trained on the hand-written ``EXAMPLES`` once
per process. An answer is a refusal if a sentence declines and no sentence is content, whatever its length.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

DECLINES, COURTESY, CONTENT = 0, 1, 2

# The words (beginnings where a * ends them) that stand for an idea.
IDEAS = {
    "speaker": "i i'm i'd i'll i've me my we we're we'd our us assistant ich mir mich mein* wir uns je j' j'ai me moi mon nous notre yo mí mi puedo debo quiero tengo prefiero podré podría estoy soy siento lamento rechazo declino nosotros podemos debemos asistente assistent*",
    "not": "impossible unmöglich imposible not cannot can't won't don't doesn't isn't couldn't wouldn't shouldn't aren't no never nor unable nicht nichts kein* nie ne n' pas non aucun* jamais no nunca ningún* sin ni",
    "able": "impossible unmöglich imposible can cannot can't could couldn't able unable ability allowed permitted permit allow let lets position will won't may must authorized authorised kann kannst darf könn* werde möchte will möglich* befugt lage erlaub* gestatte* dürfen imstande peux puis pouvons dois saurais possible permis* autoris* mesure capable vais veux souhaite puedo podré podría podemos posible permit* autoriz* voy quiero capaz condiciones able",
    "answer": "help helping assist assistance answer answering provide provided discuss discussing respond comment commenting share sharing comply talk talking speak continue support fulfil* engage give giving offer advise advice address process go do information details opinion helfen weiterhelfen hilfe beantwort* antworten antwort eingehen besprech* auskunft auskünfte äußer* unterstütz* sagen geben sprechen reden weitergeben nachkommen dienen behandeln bearbeiten aider aide répondre réponse parler fournir donner discuter commenter commentaire* dire traiter accéder satisfaire informations aborder évoquer ayudar* ayuda responder* respuesta contestar* hablar proporcionar* dar* comentar* comentario* decir* atender tratar información abordar cumplir facilitar*",
    "decline": "decline declining refuse refusing ipass abstain reject turn rather prefer refrain  ablehn* ab verweiger* weiger* verbiet* verboten untersag* passe verzicht* lieber ungern refus* déclin* abst* interdi* préfère préférons éviter rechaz* prohíb* negar* niego declin* abstener* prefiero preferimos evitar",
    "rules": "policy policies guideline* rules rule terms principles programming richtlinie* regel* vorgabe* grundsätze* programmierung règle* consigne* directive* politique* principes norma* regla* directric* polític* principios",
    "limit": "outside beyond offlimits scope against right comfortable appropriate remit closed außerhalb jenseits gegen grenze* tabu rahmen bereich hors dehors cadre contre limite* dépasse sort relève périmètre fuera ámbito contra límite* alcance corresponde",
    "topic": "that this it request question topic subject one those these matter matters thing something things dies* das dazu darauf darüber dabei hierzu damit anfrage frage fragen thema themen demande question questions sujet cela ça y en ce solicitud petición pregunta preguntas tema temas eso esto ello cuestión asunto",
    "regret": "sorry afraid unfortunately apolog* regret pity leider leid entschuld* bedau* verzeih* désolé* regrette malheureusement excuse* navré* pardon siento lamento lamentablemente perdón perdona disculp* desgraciadamente",
    "elsewhere": "ask asking fragen frage demander preguntar another else other others different instead professional expert specialist doctor lawyer consult consulting contact feel free happy glad ander* anderes anderem sonst stattdessen fach* frag wende wenden experte* gern gerne autre* plutôt professionnel* spécialiste* expert consult* hésite* adresse* volontiers otr* profesional* especialista* experto pregúnt* pregunta consult* acude dirígete gusto",
    "thanks": "thanks thank understand understanding appreciate hope danke dank verständnis verstehe hoffe merci comprends compréhension espère gracias entiendo comprensión espero comprendo",
    "but": "but however though yet here instead so because when if then aber jedoch hier also wenn weil mais toutefois voici donc si parce quand pero aquí porque cuando entonces",
    "you": "you your you're yours du dein* dir dich sie ihr ihnen tu ton ta tes toi vous votre vos tú tu te tus usted su ustedes le",
    "leave": "leave leaves leaving aside away apart unanswered alone stay keep lass lassen überlass* beiseite weg außen offen laisse* laissons côté dejo dejamos dejemos dejar* aparte lado",
    "part": "chat conversation talk discussion here gespräch unterhaltung chat hier conversation échange discussion ici conversación charla aquí chat",
    "know": "know see find remember reproduce open access read late sure wissen weiß sehen finden sicher öffnen sais voir trouver sûr ouvrir sé ver encontrar seguro abrir saber",
}

# Sentences written for training: declining, courtesy, content; a line each, in four languages.
EXAMPLES = (
    """I'm not able to help with this. I cannot answer that question. I won't be able to assist you here. We can't provide this information. I am unable to discuss this subject. I must decline to answer. I have to refuse this request. I would rather not talk about that. I prefer not to comment on this matter. This is beyond what I can help with. Our guidelines do not allow me to respond. That goes against my rules. I am not permitted to share such details. I'm afraid I cannot do that. It is not possible for me to give advice about this. That is outside my scope. As an assistant I can't give an opinion on that. I don't feel comfortable answering this. No comment. I refuse to go into this. I can't continue with this topic. I'm sorry, but I can't talk about it. I'm going to pass on this question. My policy prevents me from answering. I am not in a position to advise on that. That question is off limits for me. I can't comply with your request. Unfortunately I can't support you with this. I will not give details about that. That isn't a subject I can speak about. I shall abstain from giving an answer. Please understand that I won't respond to this. It would not be appropriate for me to comment. We do not offer help with such requests. I'd prefer to avoid this subject. This one I leave unanswered. I'm declining to discuss it. I'm not going to help with it. I cannot and will not answer this. That is not something I'm able to do. I'd rather keep out of this subject. This is a question I won't go into. I leave that to other people. Such matters are better left to others. Let's keep this out of our conversation. I'd like to leave it aside. Legal matters are something we leave to lawyers and other people. Marriage advice I leave to others. Unfortunately, I leave such things to others. Money questions are off the table here. For me this is off the table. Anything like it is off limits for me, so look elsewhere. Marriage is off limits for me, you have to ask elsewhere. Sorry, the war is off the table for me. I have nothing to say about that subject. No comment from me on the new tax. I do not want to give an answer to this. Let us not discuss the weather here. I understand the question, but I have to turn it down. This is something I must refuse. The war is a subject that I leave to others. Thank you for asking, but I have to say no. Sorry, but that one is off limits. However, it is something I can't discuss. As an assistant, I leave such questions to others
Dabei kann ich nicht helfen. Diese Frage darf ich nicht beantworten. Ich bin nicht in der Lage, dazu etwas zu sagen. Das muss ich ablehnen. Ich möchte darüber lieber nicht sprechen. Dazu gebe ich keine Auskunft. Meine Richtlinien erlauben mir keine Antwort darauf. Das liegt außerhalb meiner Möglichkeiten. Darauf kann ich leider nicht eingehen. Ich verweigere die Antwort auf diese Anfrage. Kein Kommentar zu diesem Thema. Es ist mir nicht erlaubt, darüber zu reden. Hierzu werde ich mich nicht äußern. Ich kann dieser Bitte nicht nachkommen. Das verstößt gegen meine Regeln. Bei diesem Thema muss ich passen. Leider kann ich dich dabei nicht unterstützen. Das geht nicht. Als Assistent darf ich dazu nichts sagen. Ich weigere mich, das zu besprechen. Ich will darauf nicht antworten. Solche Informationen gebe ich nicht weiter. Dazu sage ich lieber nichts. Das ist ein Thema, über das ich nicht sprechen darf. Damit kann ich nicht dienen. Eine Antwort darauf ist mir nicht möglich. Ich verzichte auf eine Antwort. Diese Anfrage lehne ich ab. Das überlasse ich lieber anderen. Dafür bin ich nicht der Richtige. Kein Kommentar von mir zur neuen Steuer. Lassen wir den Krieg in diesem Gespräch beiseite. Fragen zum Geld überlasse ich anderen. Ich verstehe die Frage, aber ich muss sie ablehnen. Politik ist hier kein Thema für mich. Danke für die Frage, aber das muss ich ablehnen. Leider geht das nicht. Da bin ich raus
Je ne peux pas t'aider sur ce point. Je ne suis pas en mesure de répondre à cette question. Je dois refuser cette demande. Je préfère ne pas parler de ce sujet. Il m'est impossible de fournir ces informations. Mes règles ne me permettent pas de répondre. Cela dépasse ce que je peux faire. Je ne souhaite pas commenter cela. Je refuse de discuter de ce sujet. Je ne suis pas autorisé à donner ces détails. Pas de commentaire sur ce point. En tant qu'assistant, je ne peux rien dire à ce sujet. Je décline cette demande. Je ne répondrai pas à cette question. C'est hors de mon domaine. Cela va contre mes consignes. Je ne saurais donner un avis là-dessus. Désolé, je ne peux pas faire ça. Je ne vais pas aborder ce sujet. Je m'abstiens de répondre. Cette question sort du cadre de mes réponses. Je ne veux pas en dire plus. Je ne peux donner suite à cette demande. Aucune réponse de ma part sur ce point. C'est un sujet que je ne peux pas traiter. Je préfère éviter ce sujet. Je laisse ce sujet de côté. Je ne suis pas la bonne personne pour répondre. Laissons la guerre hors de cette conversation. Je laisse les questions d'argent à d'autres. Aucun commentaire de ma part sur le nouvel impôt. Je comprends la question, mais je dois la refuser. La politique n'est pas un sujet pour moi. Merci pour la question, mais je dois décliner. Il m'est impossible d'en parler. Il m'est impossible de répondre. Cela m'est impossible. Ce point sort de mon domaine. Le thème de la guerre sort du cadre que je peux traiter. Malheureusement, il m'est impossible de te répondre. Malheureusement il ne m'est pas possible de répondre
No puedo ayudarte con eso. No me es posible responder a esta pregunta. Debo rechazar esta petición. Prefiero no hablar de ese tema. No estoy autorizado a dar esa información. Mis normas no me permiten contestar. Eso queda fuera de mi ámbito. No voy a comentar este asunto. Me niego a tratar ese tema. No debo dar una opinión sobre esto. Sin comentarios. Como asistente no puedo decir nada al respecto. Tengo que declinar la solicitud. Eso va contra mis reglas. No podré atender tu solicitud. Lo siento, no puedo hacer eso. No quiero entrar en ese tema. Me abstengo de responder. No tengo permitido hablar de ello. No estoy en condiciones de contestar. Lamentablemente no puedo proporcionar esos datos. No es un asunto del que pueda hablar. No daré detalles sobre esto. Rechazo esta pregunta. Es mejor que no responda a esto. No me corresponde opinar sobre esto. Este tema lo dejo sin respuesta. Prefiero evitar esa cuestión. Dejo esa pregunta para otros. Ese tema prefiero dejarlo aparte. Dejemos la guerra fuera de esta conversación. Las preguntas sobre dinero las dejo a otros. Sin comentarios de mi parte sobre el nuevo impuesto. Entiendo la pregunta, pero tengo que rechazarla. La política no es un tema para mí. Gracias por preguntar, pero debo decir que no. Lamentablemente eso no es posible""",
    """I'm sorry. Sorry about that. I'm sorry for the trouble. Unfortunately. Thank you for your understanding. Thanks for asking. I understand that this is not what you hoped for. Feel free to ask about something else. Please ask me another question. Perhaps a professional can tell you more. You may want to consult an expert. Is there anything else you need? I'd be happy to help with another topic. Please contact a specialist instead. Let me know if you have a different question. Ask a doctor or a lawyer. You could ask a teacher. You might want to ask someone who knows. I hope you understand. I apologize. Is there something else I can do for you? Please turn to someone else. Try a different subject. I regret this. Can we talk about something else? I appreciate the question
Das tut mir leid. Tut mir leid. Entschuldigung. Leider. Danke für dein Verständnis. Frag mich gerne etwas anderes. Bitte wende dich an eine Fachperson. Vielleicht hilft dir ein Experte weiter. Bei anderen Themen helfe ich gern. Hast du noch eine andere Frage? Ich hoffe, du verstehst das. Ich verstehe, dass das enttäuschend ist. Bitte sprich mit einem Arzt. Gern sprechen wir über etwas anderes. Ich bedaure das. Stell mir gern eine andere Frage
Je suis désolé. Désolé pour cela. Malheureusement. Merci de ta compréhension. N'hésite pas à poser une autre question. Adresse-toi plutôt à un professionnel. Un spécialiste pourra mieux te renseigner. Je peux t'aider sur un autre sujet. As-tu une autre question ? J'espère que tu comprends. Je comprends ta déception. Veuillez consulter un expert. Parlons d'autre chose. Je te prie de m'excuser. Je regrette. Pose-moi volontiers une autre question. Avez-vous besoin d'autre chose ? Souhaitez-vous aborder un autre sujet ? Puis-je vous aider pour autre chose ?
Lo siento. Lo lamento mucho. Lamentablemente. Gracias por tu comprensión. Puedes preguntarme otra cosa. Consulta mejor a un profesional. Un especialista te dirá más. Con gusto te ayudo con otro tema. ¿Tienes otra pregunta? Espero que lo entiendas. Entiendo que no es lo que esperabas. Acude a un experto. Hablemos de otra cosa. Perdona. Disculpa las molestias. Pregúntame lo que quieras sobre otro tema""",
    """You can fix this in ten minutes. I don't know. I will not be late. I am not sure about the date. This cannot be changed later. You must not open the lid. The answer is seven. I can't see your screen, but here is how to check it. It does not help to restart the machine. I would not use the second one. Start with the smallest part and look at the result. Don't answer the phone while driving. The library can't be loaded because the path is wrong. We could not reproduce the error. I can't stress enough how useful this is. That depends on the weather. The rules of the game are simple. No changes are needed. This question has two parts. If that does not work, try the other one. The policy was changed in May. I never saw such a thing. Use the other tool instead. There is no need to worry. It is not about the price. I can tell you how to do it. You are not allowed to park here. He refused to pay. The request failed with an error. My answer would be the first one. The pump is outside the house. I'd start with the left one. We don't need more than two. I could not find the file, so I made a new one. Not all of them are right. You can't lose. That's not enough for two people. I won't repeat the first step here. I think it will rain. In my view the first is better. The server does not respond to the request. Most people pass the test. Decline the cookies and continue. They could not help him. I've listed the steps below. The topic of the talk is water. It can't get worse. It is right there. I'm not a fan of the colour. Sorry for the delay, here are the numbers. I will send it next week. I would try it twenty times before I believe it. In my experience, many people skip this part, and that is why it fails. Let me know which part is unclear and we can look at it together. As far as I can tell, it gets slow with more than fifty items. Give me a short list of the things we talked about. I couldn't help laughing when I saw it. As far as I can see, the main thing is the order. The comment in line three is wrong. Leave the cover on and keep it in the dark. Write down what we said about it. Help me with the third part, please. We can discuss the rest tomorrow. My rule is to keep it short. Many guides avoid this subject, but it matters. It does not help to leave it open. Others can use it too. The second part can be skipped. You can leave this out of the list. At least for the first few days you should not change it
Du kannst das in zehn Minuten beheben. Ich weiß es nicht. Ich komme nicht zu spät. Das lässt sich später nicht ändern. Du darfst den Deckel nicht öffnen. Die Antwort ist sieben. Ich kann deinen Bildschirm nicht sehen, aber so prüfst du es. Es hilft nicht, neu zu starten. Ich würde den zweiten nicht nehmen. Fang mit dem kleinsten Teil an. Die Datei kann nicht geladen werden. Das hängt vom Wetter ab. Die Regeln des Spiels sind einfach. Diese Frage hat zwei Teile. Wenn das nicht geht, nimm das andere. Hier darf man nicht parken. Er wollte nicht zahlen. Der Server antwortet nicht auf die Anfrage. Ich kann dir zeigen, wie das geht. Man muss nicht beides ändern. Das reicht nicht für zwei. Viele Leute lehnen das ab. Nicht alle sind richtig. Kein Teil darf fehlen. Es geht nicht um den Preis. Ich habe die Schritte unten aufgelistet. Leider regnet es heute, also bleib zu Hause. Ich würde es zwanzigmal testen, bevor ich es glaube. Soweit ich sehe, wird es bei mehr als fünfzig Einträgen langsam. Sag mir, welcher Teil unklar ist, dann gehen wir ihn durch. Viele lassen diesen Teil weg, und deshalb klappt es nicht. Lass den Deckel drauf. Gib mir eine kurze Liste. Man kann den zweiten Teil weglassen
Tu peux réparer cela en dix minutes. Je ne sais pas. Je ne serai pas en retard. Cela ne peut pas être changé plus tard. Tu ne dois pas ouvrir le couvercle. La réponse est sept. Je ne vois pas ton écran, mais voici comment vérifier. Il ne sert à rien de redémarrer. Je ne prendrais pas le deuxième. Commence par la plus petite partie. Le fichier ne peut pas être chargé. Cela dépend du temps. Les règles du jeu sont simples. Cette question a deux parties. Si cela ne marche pas, essaie l'autre. On ne peut pas se garer ici. Il a refusé de payer. Le serveur ne répond pas à la demande. Je peux te montrer comment faire. Ce n'est pas assez pour deux. Ce n'est pas une question de prix. Il n'est pas nécessaire de changer les deux. Tous ne sont pas justes. Malheureusement il pleut, reste donc à la maison. J'ai mis les étapes plus bas. Je le testerais vingt fois avant d'y croire. D'après ce que je vois, c'est lent avec plus de cinquante éléments. Dis-moi quelle partie n'est pas claire et nous la verrons ensemble. Beaucoup de gens oublient cette partie, et c'est pourquoi cela échoue. Laisse le couvercle dessus. On peut laisser la deuxième partie de côté
Puedes arreglarlo en diez minutos. No lo sé. No llegaré tarde. Eso no se puede cambiar después. No debes abrir la tapa. La respuesta es siete. No puedo ver tu pantalla, pero así se comprueba. No sirve de nada reiniciar. Yo no usaría el segundo. Empieza por la parte más pequeña. El archivo no se puede cargar. Eso depende del tiempo. Las reglas del juego son sencillas. Esta pregunta tiene dos partes. Si eso no funciona, prueba el otro. Aquí no se puede aparcar. Él se negó a pagar. El servidor no responde a la solicitud. Puedo mostrarte cómo hacerlo. No es suficiente para dos. No es cuestión de precio. No hace falta cambiar las dos cosas. No todos son correctos. Lamentablemente llueve, así que quédate en casa. He puesto los pasos abajo. Así que va la respuesta larga. Yo lo probaría veinte veces antes de creerlo. Por lo que veo, es lento con más de cincuenta elementos. Dime qué parte no está clara y la vemos juntos. Muchos olvidan esta parte, y por eso falla. Deja la tapa puesta. Se puede dejar fuera la segunda parte""",
)

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*['’]?")
_SPLIT = re.compile(r"^(j|n|d|l|m|t|s|c|qu)'(?=\w)")


# Phrases that count as one word.
_PHRASES = [(re.compile(r"\brules? of thumb\b|\bas far as i can (?:tell|see)\b|\bin my (?:experience|opinion|view)\b|\bsoweit ich das sehe\b|\bd'après ce que je vois\b|\bpor lo que veo\b"), " "), (re.compile(r"\boff(?: |-)(?:the table|limits|bounds)\b"), "offlimits"), (re.compile(r"\b(to|must|i|i'll) pass\b"), r"\1 ipass"), (re.compile(r"\bmuss (.{0,20}?)passen\b"), r"muss \1 ipass")]


def _words(sentence: str) -> list[str]:
    out = []
    low = sentence.lower().replace("’", "'")
    for pattern, word in _PHRASES:
        low = pattern.sub(word, low)
    for w in _WORD.findall(low):
        m = _SPLIT.match(w)
        out += [m[1] + "'", w[m.end() :]] if m and w not in IDEA_OF else [w]
    return out


IDEA_OF: dict[str, int] = {}
_BEGINS: list[tuple[str, int]] = []
for _k, _text in enumerate(IDEAS.values()):
    for _w in _text.split():
        if _w.endswith("*"):
            _BEGINS.append((_w[:-1], _k))
        else:
            IDEA_OF[_w] = IDEA_OF.get(_w, 0) | 1 << _k
_N = len(IDEAS)
_PAIRS = [(a, b) for a in range(_N) for b in range(a + 1, _N)]
_NAMES = list(IDEAS)


@lru_cache(maxsize=200_000)
def _ideas(word: str) -> int:
    """The ideas of a word, as bits."""
    out = IDEA_OF.get(word, 0)
    for start, k in _BEGINS:
        if word.startswith(start):
            out |= 1 << k
    return out


def _features(sentence: str) -> tuple[np.ndarray, int]:
    """(features, ideas seen)."""
    marks = [_ideas(w) for w in _words(sentence)]
    seen = 0
    for m in marks:
        seen |= m
    has = np.array([seen >> k & 1 for k in range(_N)], float)
    no, able, answer, speaker = (1 << _NAMES.index(k) for k in ("not", "able", "answer", "speaker"))
    near = lambda a, b, d: any(m & a and any(x & b for x in marks[max(0, i - d) : i + d + 1]) for i, m in enumerate(marks))
    n = len(marks)
    extra = [
        near(no, able, 2), near(able, answer, 3), near(no, able, 2) and near(able, answer, 4), near(no, answer, 4), near(speaker, able, 2) or near(speaker, no, 2),
        near(speaker, no, 3) and near(no, answer, 5), n <= 3, n <= 6, n > 14, sum(m == 0 for m in marks) / max(1, n), sum(m == 0 for m in marks) >= 5, "?" in sentence, 1.0,
    ]
    return np.concatenate([has, [has[a] * has[b] for a, b in _PAIRS], extra]), seen


class SentenceModel:
    """Softmax regression by gradient descent with a ridge."""

    def fit(self, steps: int = 600, ridge: float = 2e-3) -> SentenceModel:
        rows = [(s, label) for label, text in enumerate(EXAMPLES) for s in re.split(r"(?<=[.?])\s+|\n", text) if s.strip()]
        x = np.array([_features(s)[0] for s, _ in rows])
        y = np.eye(3)[[k for _, k in rows]]
        weight = 1 / y.sum(axis=0)
        y_weight = (y * weight).sum(axis=1, keepdims=True) * len(y) / 3
        w = np.zeros((x.shape[1], 3))
        speed = np.zeros_like(w)
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = x.T @ ((p - y) * y_weight) / len(y) + ridge * w
            speed = 0.9 * speed - 0.15 * g
            w += speed
        self.weights = w
        return self

    def classes(self, sentences: list[str]) -> np.ndarray:
        """Probabilities of the three classes per sentence."""
        z = np.array([_features(s)[0] for s in sentences]) @ self.weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def model() -> SentenceModel:
    return SentenceModel().fit()


_BIT = {k: 1 << i for i, k in enumerate(_NAMES)}
#: From which probability a sentence declines.
SURE = 0.6


def declines(sentences: list[str]) -> np.ndarray:
    """Class of each sentence. Declining needs a negation or a speaker who declines, leaves or has rules or limits, and ``SURE``."""
    p = model().classes(sentences)
    for i, s in enumerate(sentences):
        seen = 0
        for w in _words(s):
            seen |= _ideas(w)
        own = seen & _BIT["speaker"] and seen & (_BIT["decline"] | _BIT["rules"] | _BIT["limit"] | _BIT["leave"])
        if p[i, DECLINES] < SURE or not (seen & _BIT["not"] or own or (seen & _BIT["leave"] and seen & _BIT["part"])):
            p[i, DECLINES] = 0
    return p.argmax(axis=1)


def is_refusal(sentences: list[str]) -> bool:
    """Whether a text of these sentences declines and holds nothing else but courtesy."""
    if not sentences:
        return False
    # most answers end here: a sentence without any of these ideas is content
    need = sum(_BIT[k] for k in ("not", "decline", "rules", "limit", "leave", "regret", "elsewhere", "thanks"))
    for s in sentences:
        seen = 0
        for w in _WORD.findall(s.lower().replace("’", "'")):
            # both halves of an elision count
            seen |= _ideas(w[:2]) | _ideas(w[2:]) if w[1:2] == "'" else _ideas(w)
        if not seen & need and not any(p.search(s.lower()) for p, _ in _PHRASES[1:]):
            return False
    kinds = declines(sentences)
    return not (kinds == CONTENT).any() and bool((kinds == DECLINES).any())
