"""Word lists."""

from __future__ import annotations

# The English stop words that text cleaning removes. The results depend on exactly
# these words. Entries with an apostrophe never match, because punctuation is deleted first.
ENGLISH_STOP_WORDS: tuple[str, ...] = tuple("""
a about above after again against ain all am an and any are aren aren't as at be because been
before being below between both but by can couldn couldn't d did didn didn't do does doesn doesn't
doing don don't down during each few for from further had hadn hadn't has hasn hasn't have haven
haven't having he he'd he'll her here hers herself he's him himself his how i i'd if i'll i'm in
into is isn isn't it it'd it'll it's its itself i've just ll m ma me mightn mightn't more most
mustn mustn't my myself needn needn't no nor not now o of off on once only or other our ours
ourselves out over own re s same shan shan't she she'd she'll she's should shouldn shouldn't
should've so some such t than that that'll the their theirs them themselves then there these they
they'd they'll they're they've this those through to too under until up ve very was wasn wasn't we
we'd we'll we're were weren weren't we've what when where which while who whom why will with won
won't wouldn wouldn't y you you'd you'll your you're yours yourself yourselves you've
""".split())


# Cleaning stop words that the vectorizers' own English list does not have.
_ONLY_CLEANING = set("""
ain aren couldn d did didn does doesn doing don hadn hasn haven having isn just ll m ma mightn mustn needn o s shan
shouldn t theirs ve wasn weren won wouldn y
""".split())

# Words of the vectorizers' English stop list that cleaning leaves in place.
_BEYOND_CLEANING: tuple[str, ...] = tuple("""
across afterwards almost alone along already also although always among amongst amoungst amount another anyhow anyone
anything anyway anywhere around back became become becomes becoming beforehand behind beside besides beyond bill
bottom call cannot cant co con could couldnt cry de describe detail done due eg eight either eleven else elsewhere
empty enough etc even ever every everyone everything everywhere except fifteen fifty fill find fire first five former
formerly forty found four front full get give go hasnt hence hereafter hereby herein hereupon however hundred ie inc
indeed interest keep last latter latterly least less ltd made many may meanwhile might mill mine moreover mostly move
much must name namely neither never nevertheless next nine nobody none noone nothing nowhere often one onto others
otherwise part per perhaps please put rather see seem seemed seeming seems serious several show side since sincere six
sixty somehow someone something sometime sometimes somewhere still system take ten thence thereafter thereby therefore
therein thereupon thick thin third though three throughout thru thus together top toward towards twelve twenty two un
upon us via well whatever whence whenever whereafter whereas whereby wherein whereupon wherever whether whither
whoever whole whose within without would yet
""".split())

# The second stop list, which vectorizers apply before they build n-grams; a setting of each vectorizer.
VECTORIZER_STOP_WORDS: tuple[str, ...] = (
    *(w for w in ENGLISH_STOP_WORDS if "'" not in w and w not in _ONLY_CLEANING), *_BEYOND_CLEANING)
