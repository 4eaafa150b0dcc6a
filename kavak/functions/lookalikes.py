"""Letters of other scripts that look like Latin ones."""

# Foreign letters, then the Latin letters they look like.
CYRILLIC_LATIN = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХԌԚԜҮѴаеѕіјорсухһԁԛԝѵӏү",
        "ABESIJKMHOPCTYXGQWYVaesijopcyxhdqwvly",
    )
)
GREEK_LATIN = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹαινορυϲϳ",
        "ABEZHIKMNOPTYXCaivopucj",
    )
)
# Letters with a mark of their own that look like Latin ones.
CYRILLIC_LATIN |= {"Ї": "Ï", "ї": "ï", "Ё": "Ë", "ё": "ë", "Ѐ": "È", "ѐ": "è", "ӓ": "ä", "Ӓ": "Ä", "ӧ": "ö", "Ӧ": "Ö", "Ҫ": "Ç", "ҫ": "ç", "Ә": "Ə", "ә": "ə"}
GREEK_LATIN |= {"Ϊ": "Ï", "ϊ": "ï", "ό": "ó", "Ό": "Ó"}
