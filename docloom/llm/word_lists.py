"""Short lists of function words by language, for telling languages apart and prose from lists."""

from __future__ import annotations

#: Frequent function words of four languages, as in any grammar.
FUNCTION_WORDS = {
    "en": "the of and in to a an for that with by was were is are be been at on from all as or not this it its which when if every some most their under over after before about had has have once neither nor both despite says until only but we you they he she who what how why does did do can could would should will there these those than then into out up more very our your my no so because while".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch wurden weder erst dann laut trotz warum wann wer was welche ich wir nicht kein keine weil wenn alle jedes".split(),
    "fr": "le la les de des du et à un une en dans que qui est pour par sur au avec ne pas se plus ont été a selon ni sont aux ce cette avant après d'abord puis quand parce jusqu malgré l d qu s n c je nous vous il elle ils mais ou où pourquoi comment combien être cela".split(),
    "es": "el los las la de y que en un una por con del se para al es su lo como más o pero sus le ha sin sobre este esta entre cuando ni fueron según antes desde hasta primero luego porque no yo nosotros ellos cómo cuántos qué dónde quién".split(),
}

#: Frequent function words of further languages, for telling that a text is in none of the four.
MORE_FUNCTION_WORDS = {
    "nl": frozenset("het een van en dat niet zijn werd heeft met voor ook maar door naar bij uit wordt deze geen werden hebben wat hun nog".split()),
    "it": frozenset("il lo gli di che non è sono della dei nel nella alla con anche più stato questo questa ha hanno dal dalla ma perché".split()),
    "pt": frozenset("o os um uma que não do da dos das em no na com foi são pelo pela mais ao à também mas isso este seu sua".split()),
    "sv": frozenset("och att det som på är av för med den till inte om ett har de men var från vid så kan".split()),
    "da": frozenset("og at det som på er af for med den til ikke om et har de men var fra ved så kan blev".split()),
    "pl": frozenset("i w na z nie się że do jest to od po jak za przez był była oraz dla które jego".split()),
}
