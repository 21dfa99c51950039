"""The guess of a language on sentences that its profiles were not counted in."""

import random

from pyspark.sql import functions as F

from tallyrule.functions.language import CODES, CODES_KO, SHARED, detect, guess

HELD_OUT = {
    "en": ["Guests should leave their shoes at the door.", "What did you think about the film?", "The weather was cold and it rained all week long."],
    "es": ["Los invitados deben dejar sus zapatos en la puerta.", "¿Qué te pareció la película?", "Hizo frío y llovió toda la semana.", "Hola amigos, buenos dias"],
    "pt": ["Os convidados devem deixar os sapatos na porta.", "O que você achou do filme?", "Fez frio e choveu a semana inteira."],
    "fr": ["Les invités doivent laisser leurs chaussures à la porte.", "Qu'as-tu pensé du film ?", "Il a fait froid et il a plu toute la semaine.", "Bonjour mes amis"],
    "de": ["Die Gäste sollen ihre Schuhe an der Tür lassen.", "Was hast du von dem Film gehalten?", "Es war kalt und hat die ganze Woche geregnet.", "Guten Morgen, liebe Freunde"],
    "it": ["Gli ospiti devono lasciare le scarpe alla porta.", "Che cosa ne pensi del film?", "Ha fatto freddo e ha piovuto tutta la settimana."],
    "pl": ["Goście powinni zostawić buty przy drzwiach.", "Co myślisz o tym filmie?", "Było zimno i padało przez cały tydzień."],
    "vi": ["Khách nên để giày ở cửa.", "Bạn nghĩ gì về bộ phim?", "Trời lạnh và mưa suốt cả tuần."],
    "sw": ["Wageni wanapaswa kuacha viatu vyao mlangoni.", "Ulifikiria nini kuhusu filamu hiyo?", "Kulikuwa na baridi na mvua ilinyesha wiki nzima."],
    "fi": ["Vieraiden pitää jättää kenkänsä ovelle.", "Mitä mieltä olit elokuvasta?", "Oli kylmää ja satoi koko viikon."],
    "ru": ["Гости должны оставить обувь у двери.", "Что ты думаешь об этом фильме?", "Было холодно, и всю неделю шёл дождь."],
    "uk": ["Гості повинні залишити взуття біля дверей.", "Що ти думаєш про цей фільм?", "Було холодно, і весь тиждень ішов дощ."],
    "bg": ["Гостите трябва да оставят обувките си до вратата.", "Какво мислиш за този филм?", "Беше студено и цялата седмица валя.", "България е страна"],
    "ar": ["يجب على الضيوف ترك أحذيتهم عند الباب.", "ما رأيك في هذا الفيلم؟", "كان الجو باردا وأمطرت طوال الأسبوع."],
    "ur": ["مہمانوں کو اپنے جوتے دروازے پر چھوڑنے چاہئیں۔", "فلم کے بارے میں آپ کا کیا خیال ہے؟", "سردی تھی اور پورا ہفتہ بارش ہوتی رہی۔"],
    "fa": ["مهمانان باید کفش‌های خود را دم در بگذارند.", "نظر شما درباره این فیلم چیست؟", "هوا سرد بود و تمام هفته باران می‌بارید."],
    "hi": ["मेहमानों को अपने जूते दरवाज़े पर छोड़ने चाहिए।", "आपको यह फ़िल्म कैसी लगी?", "ठंड थी और पूरे हफ्ते बारिश होती रही।"],
    "mr": ["पाहुण्यांनी आपले बूट दारात ठेवावेत.", "तुम्हाला हा चित्रपट कसा वाटला?", "थंडी होती आणि आठवडाभर पाऊस पडत होता."],
    "ne": ["पाहुनाहरूले आफ्ना जुत्ता ढोकामा छोड्नुपर्छ।", "तपाईंलाई यो चलचित्र कस्तो लाग्यो?", "जाडो थियो र हप्ताभरि पानी परिरह्यो।"],
    "ja": ["これは新しい本です。"], "zh": ["这是一本新书。"], "ko": ["이것은 새 책입니다."], "th": ["นี่คือหนังสือเล่มใหม่"], "he": ["זה ספר חדש"], "bn": ["এটি একটি নতুন বই"], "pa": ["ਇਹ ਇੱਕ ਨਵੀਂ ਕਿਤਾਬ ਹੈ"], "gu": ["આ એક નવું પુસ્તક છે"],
    "ta": ["இது ஒரு புதிய புத்தகம்"], "te": ["ఇది కొత్త పుస్తకం"], "kn": ["ಇದು ಹೊಸ ಪುಸ್ತಕ"], "ml": ["ഇതൊരു പുതിയ പുസ്തകമാണ്"],
}


def test_held_out_sentences():
    assert set(HELD_OUT) == set(CODES_KO) and CODES_KO[:-1] == CODES
    right = {code: sum(guess(x) == code for x in xs) for code, xs in HELD_OUT.items()}
    assert min(right.values()) > 0
    assert sum(right.values()) >= 0.95 * sum(map(len, HELD_OUT.values()))


def test_short_pieces_of_held_out_text():
    """Any half of a sentence or more: at least 95 of 100 are told."""
    r, right, n = random.Random(5), 0, 0
    for code in (c for v in SHARED.values() for c in v):
        words = " ".join(HELD_OUT[code]).split()
        for _ in range(50):
            at, size = r.randrange(len(words) - 4), r.randint(5, 9)
            n += 1
            right += guess(" ".join(words[at : at + size])) == code
    assert right >= 0.95 * n


def test_awkward_texts(spark):
    texts = [None, "", " \n", "123 !?", "ÄÖ", "a", "日", "日あ", "x" * 100_000, "\U0001d11e", "é", "THE CAT IS IN THE HAT", "Ы", "ش", "ह"]
    df = spark.createDataFrame([(k, [t, "the cat"]) for k, t in enumerate(texts)] + [(99, None)], "k int, x array<string>").repartition(3)
    once = {r.k: r.g for r in df.select("k", detect(F.col("x")).alias("g")).collect()}
    assert once == {r.k: r.g for r in df.select("k", detect(F.col("x")).alias("g")).collect()}
    assert once[99] is None and all(once[k] == [guess(t), "en"] for k, t in enumerate(texts))
    assert [guess(t) for t in texts[:4]] == [None] * 4 and guess("\U0001d11e") is None
    assert (guess("日"), guess("日あ"), guess("Ы") in SHARED["cyrillic"], guess("Þ") in SHARED["latin"]) == ("zh", "ja", True, True)
