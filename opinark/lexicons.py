"""Word lists and label sets of the cleaning and labelling stages."""

# Nouns too general to be an aspect.
GENERIC_NOUNS = (
    "thing", "things", "stuff", "item", "items", "product", "products", "object", "objects",
    "part", "parts", "piece", "pieces", "kind", "kinds", "type", "types", "sort", "sorts",
    "one", "ones", "something", "anything", "everything", "nothing", "someone", "anyone",
    "everyone", "nobody", "aspect", "issue", "issues", "lot", "bit", "matter", "way",
    "case", "point", "side", "version", "time", "times", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "problem", "problems", "reason", "reasons",
    "result", "results", "experience", "review", "reviews", "rating", "ratings", "star", "stars",
)

# Words about buying and sending rather than the product.
DOMAIN_NOISE = (
    "amazon", "seller", "sellers", "shipping", "delivery", "shipment", "shipments", "package",
    "packages", "packaging", "box", "boxes", "wrapper", "wrappers", "return", "returns",
    "refund", "refunds", "replacement", "replacements",
)

# Contractions replaced as whole words.
WORD_CONTRACTIONS = {
    "ain't": "is not", "aren't": "are not", "can't": "can not", "can't've": "can not have",
    "could've": "could have", "couldn't": "could not", "didn't": "did not", "doesn't": "does not",
    "don't": "do not", "hadn't": "had not", "hasn't": "has not", "haven't": "have not",
    "he'd": "he would", "he'll": "he will", "he's": "he is", "how'd": "how did", "how's": "how is",
    "i'd": "i would", "i'll": "i will", "i'm": "i am", "i've": "i have", "isn't": "is not",
    "it'd": "it would", "it'll": "it will", "it's": "it is", "let's": "let us",
    "might've": "might have", "mightn't": "might not", "must've": "must have", "mustn't": "must not",
    "shan't": "shall not", "she'd": "she would", "she'll": "she will", "she's": "she is",
    "should've": "should have", "shouldn't": "should not", "that'd": "that would", "that's": "that is",
    "there's": "there is", "they'd": "they would", "they'll": "they will", "they're": "they are",
    "they've": "they have", "wasn't": "was not", "we'd": "we would", "we'll": "we will",
    "we're": "we are", "we've": "we have", "weren't": "were not", "what's": "what is",
    "where's": "where is", "who's": "who is", "won't": "will not", "would've": "would have",
    "wouldn't": "would not", "you'd": "you would", "you'll": "you will", "you're": "you are",
    "you've": "you have",
}

# Contractions replaced wherever they stand, longest first.
SUBSTRING_CONTRACTIONS = {
    "won't": "will not", "can't": "can not", "shan't": "shall not",
    "n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'d": " would", "'m": " am",
    "let's": "let us", "it's": "it is", "that's": "that is", "what's": "what is",
    "there's": "there is", "here's": "here is", "who's": "who is", "how's": "how is",
    "where's": "where is", "he's": "he is", "she's": "she is",
    "i'm": "i am", "you're": "you are", "we're": "we are", "they're": "they are",
    "i've": "i have", "you've": "you have", "we've": "we have", "they've": "they have",
    "i'll": "i will", "you'll": "you will", "he'll": "he will", "she'll": "she will",
    "we'll": "we will", "they'll": "they will",
    "i'd": "i would", "you'd": "you would", "he'd": "he would", "she'd": "she would",
    "we'd": "we would", "they'd": "they would",
    "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not",
    "hasn't": "has not", "haven't": "have not", "hadn't": "had not",
    "doesn't": "does not", "don't": "do not", "didn't": "did not",
    "wouldn't": "would not", "shouldn't": "should not", "couldn't": "could not",
    "mustn't": "must not", "needn't": "need not",
}

# Whole sentences that are politeness only.
SOCIAL_PATTERNS = (
    "(thank|thanks|thank you)( so much)?",
    "thanks again",
    "have a nice day",
    "best regards|kind regards|warm regards",
    "happy holidays|merry christmas",
)

# Verbs of opinion, linking verbs and pronouns, by lemma.
OPINION_VERBS = (
    "adore", "admire", "annoy", "appreciate", "avoid", "confuse", "despise", "disappoint",
    "dislike", "disturb", "enjoy", "favor", "hate", "impress", "like", "love", "need",
    "prefer", "recommend", "regret", "satisfy", "surprise", "value", "want", "wish",
)
LINKING_VERBS = ("be", "become", "feel", "look", "remain", "seem", "smell", "sound", "stay", "taste")
PRONOUNS = ("i", "it", "this", "that", "these", "those", "they", "he", "she", "them", "him", "her")

GENERIC_TAG, NOISE_TAG = "[GENERIC_NOUN]", "[DOMAIN_NOISE]"

#: Sentiment labels 0, 1, 2.
SENTIMENTS = ("negative", "neutral", "positive")
#: Token labels of aspect spans.
BIO_LABELS = ("O", "B-ASP", "I-ASP")
