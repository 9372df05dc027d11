"""The language of a text: scripts, then a character n-gram model of words.

Scripts that belong to one language (or are read as one here) are told by their letters. Words in Latin and
Cyrillic letters are scored by the n-grams (one to four letters, with word bounds) of each language, counted on
the ``SAMPLES`` below: a word's scores are made once per process and remembered, so a text costs one look-up a word.

Defined results: a null, empty or letterless text has no language; a tie has none.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np

#: Words whose scores a process remembers before it starts anew.
MEMORY = 200_000

# A few sentences of everyday writing in each language.
SAMPLES = {
    "en": "All people are born free and equal. What should I do when the first answer does not help, and how can I find out which of the two is better? It is usually enough to look at the numbers again before you change anything. Most of them think that this will take about ten minutes, but you would need more time if there are many files. Please tell me why they were late; we had to wait for them at the station with our friends. Let me know if it works. He said she could keep it until next week. Here is an example of what they have done so far. Thank you for your message, I hope you are well. The weather was good and the children played outside. Use only as much as you need, then try the other one. I've never seen such a thing, and I don't believe it's true. You can make it yourself without any tools. Put simply, each part depends on the rest",
    "de": "Alle Menschen sind frei und gleich geboren. Was soll ich tun, wenn die erste Antwort nicht hilft, und wie finde ich heraus, welche von beiden besser ist? Meistens reicht es, die Zahlen noch einmal anzusehen, bevor du etwas änderst. Die meisten denken, dass das etwa zehn Minuten dauert, aber man braucht mehr Zeit, wenn es viele Dateien gibt. Bitte sag mir, warum sie zu spät waren; wir mussten am Bahnhof mit unseren Freunden auf sie warten. Er hat gesagt, dass sie es bis nächste Woche behalten kann. Hier ist ein Beispiel für das, was bisher gemacht wurde. Danke für deine Nachricht, ich hoffe, es geht dir gut. Das Wetter war schön und die Kinder haben draußen gespielt. Nimm nur so viel, wie du brauchst, und versuche dann den anderen. So etwas habe ich noch nie gesehen, und ich glaube nicht, dass es wahr ist. Man kann es ohne Werkzeug selbst machen. Einfach gesagt hängt jeder Teil vom Rest ab, auch wenn einer fehlt",
    "fr": "Tous les êtres humains naissent libres et égaux. Que dois-je faire quand la première réponse n'aide pas, et comment savoir laquelle des deux est la meilleure ? Il suffit souvent de regarder encore une fois les chiffres avant de changer quelque chose. La plupart pensent que cela prend environ dix minutes, mais il faut plus de temps s'il y a beaucoup de fichiers. Dis-moi pourquoi ils étaient en retard, s'il te plaît ; nous avons dû les attendre à la gare avec nos amis. Il a dit qu'elle pouvait le garder jusqu'à la semaine prochaine. Voici un exemple de ce qui a été fait jusqu'ici. Merci pour ton message, j'espère que tu vas bien. Le temps était beau et les enfants jouaient dehors. Ne prends que ce dont tu as besoin, puis essaie l'autre. Je n'ai jamais vu une chose pareille et je ne crois pas que ce soit vrai. On peut le faire soi-même sans outil. En bref, chaque partie dépend du reste",
    "es": "Todos los seres humanos nacen libres e iguales. ¿Qué debo hacer cuando la primera respuesta no ayuda y cómo puedo saber cuál de las dos es mejor? Casi siempre basta con mirar otra vez los números antes de cambiar algo. La mayoría piensa que esto tarda unos diez minutos, pero hace falta más tiempo si hay muchos archivos. Por favor, dime por qué llegaron tarde; tuvimos que esperarlos en la estación con nuestros amigos. Él dijo que ella podía quedárselo hasta la próxima semana. Aquí tienes un ejemplo de lo que se ha hecho hasta ahora. Gracias por tu mensaje, espero que estés bien. Hacía buen tiempo y los niños jugaban fuera. Usa solo lo que necesites y luego prueba el otro. Nunca he visto una cosa así y no creo que sea verdad. Puedes hacerlo tú mismo sin herramientas. En pocas palabras, cada parte depende del resto, y eso lo sabe todo el mundo",
    "it": "Tutti gli esseri umani nascono liberi ed eguali. Che cosa devo fare quando la prima risposta non aiuta e come posso sapere quale delle due è migliore? Di solito basta guardare ancora una volta i numeri prima di cambiare qualcosa. La maggior parte pensa che questo richieda circa dieci minuti, ma ci vuole più tempo se ci sono molti file. Per favore dimmi perché sono arrivati tardi; abbiamo dovuto aspettarli alla stazione con i nostri amici. Lui ha detto che lei poteva tenerlo fino alla prossima settimana. Ecco un esempio di quello che è stato fatto finora. Grazie per il tuo messaggio, spero che tu stia bene. Il tempo era bello e i bambini giocavano fuori. Usa solo quello che ti serve, poi prova l'altro. Non ho mai visto una cosa del genere e non credo che sia vera. Si può fare da soli senza attrezzi. In breve, ogni parte dipende dal resto, anche se nessuno lo dice",
    "pt": "Todos os seres humanos nascem livres e iguais. O que devo fazer quando a primeira resposta não ajuda e como posso saber qual das duas é melhor? Geralmente basta olhar outra vez para os números antes de mudar alguma coisa. A maioria pensa que isto demora cerca de dez minutos, mas é preciso mais tempo se houver muitos ficheiros. Por favor, diz-me porque chegaram tarde; tivemos de esperar por eles na estação com os nossos amigos. Ele disse que ela podia ficar com ele até à próxima semana. Aqui está um exemplo do que foi feito até agora. Obrigado pela tua mensagem, espero que estejas bem. O tempo estava bom e as crianças brincavam lá fora. Usa só o que precisas e depois experimenta o outro. Você nunca viu uma coisa assim e eu não acredito que seja verdade. Em poucas palavras, cada parte depende do resto, e isso todos sabem",
    "nl": "Alle mensen worden vrij en gelijk geboren. Wat moet ik doen als het eerste antwoord niet helpt, en hoe kom ik erachter welke van de twee beter is? Meestal is het genoeg om nog een keer naar de cijfers te kijken voordat je iets verandert. De meesten denken dat dit ongeveer tien minuten duurt, maar er is meer tijd nodig als er veel bestanden zijn. Vertel me alsjeblieft waarom ze te laat waren; we moesten op het station met onze vrienden op hen wachten. Hij zei dat zij het tot volgende week mocht houden. Hier is een voorbeeld van wat er tot nu toe is gedaan. Bedankt voor je bericht, ik hoop dat het goed met je gaat. Het weer was mooi en de kinderen speelden buiten. Gebruik alleen wat je nodig hebt en probeer dan de andere. Zoiets heb ik nog nooit gezien en ik geloof niet dat het waar is. Kort gezegd hangt elk deel af van de rest",
    "sv": "Alla människor är födda fria och lika. Vad ska jag göra när det första svaret inte hjälper, och hur kan jag veta vilken av de två som är bättre? Oftast räcker det att titta på siffrorna en gång till innan du ändrar något. De flesta tror att det tar ungefär tio minuter, men man behöver mer tid om det finns många filer. Snälla säg mig varför de kom för sent; vi fick vänta på dem vid stationen med våra vänner. Han sa att hon kunde behålla den till nästa vecka. Här är ett exempel på vad som har gjorts hittills. Tack för ditt meddelande, jag hoppas att du mår bra. Vädret var fint och barnen lekte ute. Använd bara så mycket du behöver och prova sedan den andra. Jag har aldrig sett något sådant och jag tror inte att det är sant. Kort sagt beror varje del på resten",
    "da": "Alle mennesker er født frie og lige. Hvad skal jeg gøre, når det første svar ikke hjælper, og hvordan kan jeg vide, hvilken af de to der er bedst? Som regel er det nok at se på tallene en gang til, før du ændrer noget. De fleste tror, at det tager omkring ti minutter, men man skal bruge mere tid, hvis der er mange filer. Sig mig venligst, hvorfor de kom for sent; vi måtte vente på dem på stationen med vores venner. Han sagde, at hun kunne beholde den til næste uge. Her er et eksempel på, hvad der er gjort indtil nu. Tak for din besked, jeg håber, at du har det godt. Vejret var fint, og børnene legede udenfor. Brug kun så meget, du har brug for, og prøv så den anden. Sådan noget har jeg aldrig set, og jeg tror ikke, det er sandt",
    "pl": "Wszyscy ludzie rodzą się wolni i równi. Co mam zrobić, kiedy pierwsza odpowiedź nie pomaga, i jak mogę się dowiedzieć, która z nich jest lepsza? Zwykle wystarczy jeszcze raz spojrzeć na liczby, zanim coś zmienisz. Większość myśli, że to trwa około dziesięciu minut, ale potrzeba więcej czasu, jeśli jest dużo plików. Powiedz mi proszę, dlaczego się spóźnili; musieliśmy czekać na nich na dworcu z naszymi przyjaciółmi. On powiedział, że ona może to zatrzymać do przyszłego tygodnia. Oto przykład tego, co zostało zrobione do tej pory. Dziękuję za wiadomość, mam nadzieję, że u ciebie wszystko dobrze. Pogoda była ładna i dzieci bawiły się na dworze. Używaj tylko tyle, ile potrzebujesz, a potem spróbuj drugiego. Nigdy czegoś takiego nie widziałem i nie wierzę, że to prawda. Krótko mówiąc, każda część zależy od reszty",
    "cs": "Všichni lidé se rodí svobodní a rovní. Co mám dělat, když první odpověď nepomáhá, a jak zjistím, která z nich je lepší? Většinou stačí podívat se na čísla ještě jednou, než něco změníš. Většina si myslí, že to trvá asi deset minut, ale je potřeba více času, pokud je tam hodně souborů. Řekni mi prosím, proč přišli pozdě; museli jsme na ně čekat na nádraží s našimi přáteli. On řekl, že si to ona může nechat do příštího týdne. Tady je příklad toho, co se zatím udělalo. Děkuji za zprávu, doufám, že se máš dobře. Počasí bylo hezké a děti si hrály venku. Použij jen tolik, kolik potřebuješ, a pak zkus ten druhý. Nikdy jsem nic takového neviděl a nevěřím, že je to pravda",
    "tr": "Bütün insanlar özgür ve eşit doğar. İlk cevap yardımcı olmazsa ne yapmalıyım ve hangisinin daha iyi olduğunu nasıl bulabilirim? Genellikle bir şeyi değiştirmeden önce sayılara bir kez daha bakmak yeterlidir. Çoğu bunun yaklaşık on dakika sürdüğünü düşünüyor ama çok dosya varsa daha fazla zaman gerekir. Lütfen bana neden geç kaldıklarını söyle; istasyonda arkadaşlarımızla onları beklemek zorunda kaldık. O, gelecek haftaya kadar onda kalabileceğini söyledi. Şimdiye kadar yapılanların bir örneği burada. Mesajın için teşekkürler, umarım iyisindir. Hava güzeldi ve çocuklar dışarıda oynuyordu. Sadece ihtiyacın kadar kullan, sonra diğerini dene. Böyle bir şeyi hiç görmedim ve doğru olduğuna inanmıyorum. Kısacası her parça geri kalanına bağlıdır",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina. Mitä minun pitäisi tehdä, kun ensimmäinen vastaus ei auta, ja miten saan selville, kumpi niistä on parempi? Yleensä riittää, että katsot numeroita vielä kerran ennen kuin muutat mitään. Useimmat luulevat, että se kestää noin kymmenen minuuttia, mutta aikaa tarvitaan enemmän, jos tiedostoja on paljon. Kerro minulle, miksi he myöhästyivät; meidän piti odottaa heitä asemalla ystäviemme kanssa. Hän sanoi, että sen voi pitää ensi viikkoon asti. Tässä on esimerkki siitä, mitä on tähän mennessä tehty. Kiitos viestistäsi, toivottavasti voit hyvin. Sää oli kaunis ja lapset leikkivät ulkona. Käytä vain sen verran kuin tarvitset ja kokeile sitten toista. En ole koskaan nähnyt sellaista enkä usko, että se on totta",
    "hu": "Minden ember szabadnak és egyenlőnek születik. Mit tegyek, ha az első válasz nem segít, és hogyan tudhatom meg, hogy melyik a jobb? Általában elég még egyszer megnézni a számokat, mielőtt bármit megváltoztatsz. A legtöbben azt hiszik, hogy ez körülbelül tíz percig tart, de több idő kell, ha sok fájl van. Kérlek, mondd meg, miért késtek; a barátainkkal az állomáson kellett várnunk rájuk. Azt mondta, hogy a jövő hétig megtarthatja. Itt van egy példa arra, amit eddig csináltak. Köszönöm az üzenetedet, remélem, jól vagy. Az idő szép volt, és a gyerekek kint játszottak. Csak annyit használj, amennyire szükséged van, aztán próbáld ki a másikat",
    "ro": "Toate ființele umane se nasc libere și egale. Ce ar trebui să fac când primul răspuns nu ajută și cum pot afla care dintre cele două este mai bun? De obicei este suficient să te uiți încă o dată la numere înainte de a schimba ceva. Cei mai mulți cred că durează cam zece minute, dar este nevoie de mai mult timp dacă sunt multe fișiere. Te rog spune-mi de ce au întârziat; a trebuit să îi așteptăm la gară cu prietenii noștri. El a spus că ea îl poate păstra până săptămâna viitoare. Iată un exemplu a ceea ce s-a făcut până acum. Mulțumesc pentru mesaj, sper că ești bine. Vremea era frumoasă și copiii se jucau afară",
    "id": "Semua orang dilahirkan merdeka dan mempunyai hak yang sama. Apa yang harus saya lakukan kalau jawaban pertama tidak membantu, dan bagaimana saya bisa tahu mana yang lebih baik? Biasanya cukup melihat angka sekali lagi sebelum kamu mengubah sesuatu. Kebanyakan orang mengira ini memakan waktu sekitar sepuluh menit, tetapi perlu lebih banyak waktu jika ada banyak berkas. Tolong katakan mengapa mereka terlambat; kami harus menunggu mereka di stasiun dengan teman kami. Dia berkata bahwa itu boleh disimpan sampai minggu depan. Ini contoh dari apa yang sudah dikerjakan sampai sekarang. Terima kasih atas pesanmu, semoga kamu baik",
    "ru": "Все люди рождаются свободными и равными. Что мне делать, если первый ответ не помогает, и как узнать, какой из двух лучше? Обычно достаточно ещё раз посмотреть на числа, прежде чем что-то менять. Большинство думает, что это займёт около десяти минут, но нужно больше времени, если файлов много. Пожалуйста, скажи мне, почему они опоздали; нам пришлось ждать их на вокзале с нашими друзьями. Он сказал, что она может оставить это до следующей недели. Вот пример того, что уже сделано. Спасибо за сообщение, надеюсь, у тебя всё хорошо. Погода была хорошая, и дети играли на улице. Я никогда такого не видел и не верю, что это правда",
    "uk": "Усі люди народжуються вільними і рівними. Що мені робити, якщо перша відповідь не допомагає, і як дізнатися, яка з двох краща? Зазвичай достатньо ще раз подивитися на числа, перш ніж щось змінювати. Більшість думає, що це займе близько десяти хвилин, але потрібно більше часу, якщо файлів багато. Будь ласка, скажи мені, чому вони запізнилися; нам довелося чекати на них на вокзалі з нашими друзями. Він сказав, що вона може залишити це до наступного тижня. Ось приклад того, що вже зроблено. Дякую за повідомлення, сподіваюся, у тебе все добре",
}
# Short words that are frequent in a language; they count as further samples.
FREQUENT = {
    "en": "the a an and or of to in is are it that this for with on as at by be you your my what which how do does can if not but from about there one when would should have has its more most only so too before after them then i we they was were will could let me see every any no than into out up whatever because while once again",
    "de": "der die das und oder ein eine einen einem einer ist sind zu von mit für auf im am bei nicht auch es sich wenn was wie du ich wir mir mich dir dem den des dass aber nur noch mehr als werden wird kann kannst würde soll sollte etwas zum zur aus nach über unter warum welche hilf bitte gib ihr so man denn dann wann mal viele immer jedenfalls weil sobald damit",
    "es": "el la los las un una y o de del que en es son con por para no se su lo al como más pero si cuando qué cuál cómo me te mi tu ya hay muy sobre este esta eso esto todo está puedes debería entre antes después sin porque dos unos desde hasta también nada otra ser hace falta dame dime pasos mejorar mejor gente aprender forma primero",
    "fr": "le la les un une et ou de des du que qui en est sont avec pour pas ne se sa son au aux ce cette il elle je tu nous vous on dans sur par plus mais si quand quoi comment quelles quel mon ma mes ton ta y a être avoir cela ça fait faire comme tout peux dois entre avant après sans car deux dont où c'est d'un d'une qu'il n'est donne aide moi bref puis parce",
    "it": "il lo la i gli le un una e o di del della dei che in è sono con per non si su al come più ma se quando cosa quale mi ti mio tuo già c'è molto questo questa quello tutto puoi dovrebbe prima dopo senza perché anche niente essere fa dammi dimmi quindi nel nella alla dal",
    "pt": "o a os as um uma e ou de do da dos das que em é são com por para não se seu ao como mais mas quando qual me te meu teu já há muito sobre este esta isso isto tudo está pode deve entre antes depois sem porque dois desde até também nada ser faz você no na pelo pela",
    "nl": "de het een en of van dat in is zijn met voor niet op aan als maar je ik we mijn wat welke hoe er om te bij uit naar over ook nog meer dan kan wordt worden moet zou deze dit die waarom omdat wanneer geen wel heeft",
}

# Letters of scripts that are read as one language each.
_SCRIPTS = [
    ("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯]")), ("zh", re.compile(r"[㐀-鿿]")), ("ar", re.compile(r"[؀-ۿ]")), ("he", re.compile(r"[֐-׿]")),
    ("el", re.compile(r"[Ͱ-Ͽἀ-῿]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("th", re.compile(r"[฀-๿]")),
]
_OTHER = re.compile(r"[Ͱ-Ͽ֐-׿؀-ۿऀ-ॿ฀-๿ἀ-῿぀-ヿ㐀-鿿가-힯]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
LANGUAGES = tuple(SAMPLES)


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + k] for k in (2, 3, 4) for i in range(len(w) - k + 1)] + ([w] if len(w) > 4 else [])


class LanguageModel:
    """Naive Bayes over the n-grams of words; the scores of a word are remembered."""

    def __init__(self) -> None:
        counts: dict[str, np.ndarray] = {}
        for k, (name, text) in enumerate(SAMPLES.items()):
            for word, times in [(w, 1.0) for w in _WORD.findall(text.lower())] + [(w, 2.0) for w in FREQUENT.get(name, "").split()]:
                for g in _grams(word.replace("’", "'")):
                    counts.setdefault(g, np.zeros(len(SAMPLES)))[k] += times
        total = sum(counts.values())
        self.logs = {g: np.log((v + 0.3) / (total + 0.3 * 4_000)) for g, v in counts.items()}
        self.unseen = np.log(0.3 / (total + 0.3 * 4_000))
        self.memory: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, len(SAMPLES)))

    def _row(self, word: str) -> int:
        at = self.memory.get(word)
        if at is None:
            logs = [self.logs.get(g) for g in _grams(word)]
            known = [v for v in logs if v is not None]
            # an n-gram no language has tells nothing; a word counts as its letters' evidence, the longer ones not in proportion
            row = sum((v - v.mean() for v in known), np.zeros(len(SAMPLES)))
            row = row / math.sqrt(max(1, len(known)))
            at = self.memory[word] = len(self.rows)
            self.rows.append(row)
        return at

    def scores(self, words: list[str]) -> np.ndarray:
        """The sum of the words' scores per language."""
        at = list(map(self.memory.get, words))
        if None in at:
            if len(self.memory) + len(at) > MEMORY:
                self.memory, self.rows, self.table = {}, [], self.table[:0]
            at = [self._row(w) for w in words]
            self.table = np.vstack([self.table, *self.rows[len(self.table) :]])
        return self.table[at].sum(axis=0) if at else np.zeros(len(SAMPLES))


@lru_cache(maxsize=1)
def model() -> LanguageModel:
    return LanguageModel()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("’", "'"))


def language(text: str | None) -> tuple[str | None, float, float]:
    """(language, its lead over the next one per word, number of words judged)."""
    if not text:
        return None, 0.0, 0.0
    other = 0 if text.isascii() else len(_OTHER.findall(text))
    ws = words_of(text)
    letters = sum(map(len, ws))
    if other and other >= 0.4 * letters:
        name = max(_SCRIPTS, key=lambda s: (len(s[1].findall(text)) * (3 if s[0] == "ja" else 1)))[0]
        return name, 2.0, other / 2.0
    if not ws:
        return None, 0.0, 0.0
    s = model().scores(ws)
    order = np.argsort(-s)
    lead = float(s[order[0]] - s[order[1]])
    return (LANGUAGES[int(order[0])] if lead > 0 else None), lead / len(ws), float(len(ws))


def lead(text: str, one: str, other: str) -> float:
    """By how much ``one`` language is more likely than ``other`` per word of ``text``."""
    if one not in LANGUAGES or other not in LANGUAGES:
        return 2.0
    ws = words_of(text)
    s = model().scores(ws)
    return float(s[LANGUAGES.index(one)] - s[LANGUAGES.index(other)]) / max(1, len(ws))
