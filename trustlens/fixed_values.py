"""Fixed values that must equal the original system's for equal results.

FIXED VALUES — weights, thresholds, class order, and the default Russian word lists
(stop words and aspect seed words) in their natural order. Everything else in the
library takes word lists as input tables; these are only the defaults.
"""

# --- trust score weights, summed in this order ---
TRUST_WEIGHTS = (
    ("length", 0.15),
    ("diversity", 0.25),
    ("emotion", 0.25),
    ("quality", 0.20),
    ("similarity", 0.15),
)

# --- length signal ---
MIN_WORDS = 5
MAX_WORDS = 300

# --- diversity signal: sliding window over tokens ---
DIVERSITY_MIN_TOKENS = 3
DIVERSITY_WINDOW = 20
DIVERSITY_STEP = 10

# --- emotion signal ---
EMOTION_MIN_HITS = 3
EMOTION_NEUTRAL = 0.5
EMOTION_STD_CAP = 0.5

# --- quality signal ---
QUALITY_LETTER_RATIO = 0.6
QUALITY_REPEAT_PENALTY = 0.2
QUALITY_LINK_SCORE = 0.3
QUALITY_CAPS_FREE = 0.4
QUALITY_CAPS_PENALTY = 3.0
LINK_PATTERN = r"http|www\.|@"

# --- similarity signal ---
SIMILARITY_THRESHOLD = 0.85
VOCABULARY_SIZE = 2000

# --- report and verdict thresholds ---
SUSPICIOUS_BELOW = 50.0          # batch: rounded trust < 50 is suspicious
SAFE_ABOVE = 50.0                # single review: trust > 50 is safe
HEALTH_TOP_BAND = 80.0
HEALTH_MIDDLE_BAND = 50.0

# --- corpus preparation ---
RATING_POSITIVE_MIN = 4.0
RATING_NEGATIVE_MAX = 2.0
SENTIMENT_LABELS = (("negative", 0), ("positive", 1))
CANDIDATE_POOL_SIZE = 500
SEED_ROOT_CHARS = 5
MIN_LEMMA_CHARS = 3
SPLIT_SEED = 42
TRAIN_SHARE = 0.8
VALIDATION_SHARE = 0.1
ASPECT_THRESHOLD = 0.5
NO_ASPECTS = "—"            # the dash shown when a review has no aspect

# --- default alphabets (regex character-class bodies) ---
CYRILLIC = "а-яёА-ЯЁ"
CYRILLIC_LATIN = "а-яёА-ЯЁa-zA-Z"
CAPITALS = "А-ЯЁA-Z"

# --- default aspect classes, in label order; the last one is the fallback class ---
ASPECTS = ["качество", "цена", "доставка", "сервис", "соответствие", "другое"]
OTHER_ASPECT = "другое"

# --- default stop words ---
STOPWORDS = [
    "и", "в", "на", "не", "что", "это", "с", "по", "за", "а", "но", "как",
    "все", "так", "то", "от", "к", "для", "у", "из", "до", "бы", "ли", "же",
    "или", "да", "о", "об", "при", "без", "под", "над", "уже", "ещё", "еще",
    "мне", "мы", "я", "он", "она", "они", "оно", "вы", "вам", "нам",
    "очень", "его", "её", "их", "был", "была", "были", "быть", "есть",
    "который", "которая", "которые", "этот", "эта", "эти", "того", "тоже",
    "чтобы", "когда", "если", "там", "здесь", "тут", "можно", "нет",
    "просто", "только", "вот", "ну", "ни", "всё", "раз",
    "мой", "моя", "моё", "мои", "свой", "своя", "своё", "свои",
    "товар", "отзыв", "купить", "заказать",
    "каспи", "kaspi", "wildberries", "ozon", "озон", "банк",
    "через", "после", "потом", "один", "два", "вообще", "пока",
]

# --- default aspect seed words, per aspect in class order ---
ASPECT_SEEDS = {
    "качество": [
        "качество", "материал", "ткань", "брак", "прочный", "прочность",
        "износ", "сломаться", "ломаться", "дефект", "шов", "нитка",
        "торчать", "синтетика", "натуральный", "плотный", "хрупкий",
        "работать", "работа", "функция", "производительность", "батарея",
        "экран", "камера", "корпус", "сборка", "глючить", "зависать",
        "нагреваться", "заряд", "поломка", "ремонт", "звук",
        "громкость", "изображение", "яркость", "процессор",
    ],
    "цена": [
        "цена", "стоимость", "дорого", "дешево", "переплатить", "скидка",
        "деньги", "стоить", "дорогой", "дешевый", "переплата",
        "выгодный", "экономия", "ценник", "бюджет",
        "соотношение", "окупиться", "жалеть", "переплачивать", "акция",
    ],
    "доставка": [
        "доставка", "курьер", "прийти", "привезти", "ждать", "ожидание",
        "упаковка", "посылка", "почта", "задержка", "опоздать",
        "отследить", "трек", "прислать", "получить", "быстро", "долго",
        "срок", "везти", "доставить", "опоздание", "сохранность",
    ],
    "сервис": [
        "продавец", "поддержка", "ответить", "помочь", "вернуть",
        "возврат", "обещать", "обман", "обмануть", "сервис",
        "общение", "консультант", "жалоба", "претензия", "вежливый",
        "гарантия", "замена", "отказать", "игнорировать", "служба",
    ],
    "соответствие": [
        "размер", "цвет", "фото", "описание", "картинка", "отличаться",
        "маломерить", "большемерить", "оттенок", "другой",
        "ожидать", "совпадать", "реальный", "несоответствие",
        "характеристика", "заявленный", "комплектация", "оригинал",
        "подделка", "отличие", "соответствовать",
    ],
}
