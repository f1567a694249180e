"""Inspected examples: short texts that name the components of the mixture in prose.py. Each group seeds one component."""

from __future__ import annotations

import random

PROSE: dict[str, list[str]] = {
    "sentences": [
        "I was not sure at first, yet the lens cap holds up well and the strap saves me a lot of time. The box holds the device, a leaflet and a spare part.",
        "The service answered after three days and did not help at all. I paid 65 for this and the inner frame smells of glue!",
        "Die Lieferung kam nach 58 Tagen und war gut verpackt. Dann hat es sich mein Vater ausgeliehen und war ebenfalls begeistert.",
        "Pour ce prix, je m'attendais à moins. Le bouchon ne m'a jamais posé de problème. Le colis est arrivé en 11 jours, bien emballé.",
        "Lo usamos unas 35 veces al mes. Luego se lo presté a mi hermana y también quedó muy contento. Pesa un poco más que el anterior.",
        "We took it to the mountains last week. It rained the whole time, but nothing got wet inside and I could still reach everything I needed.",
        "Ich habe lange gesucht und mich dann für dieses Modell entschieden, weil es leicht ist. Leider ist nach zwei Wochen der Griff abgebrochen.",
        "J'ai commandé cet article pour ma mère, qui en avait besoin pour ses vacances. Elle en est très contente et elle l'utilise tous les jours.",
        "El pedido llegó antes de lo que esperaba y todo estaba en la caja. La pantalla se ve bien, aunque el cable es demasiado corto para mi mesa.",
    ],
    "one sentence": [
        "The viewfinder hood gets far too hot.",
        "The leaflet could be longer, but you get by.",
        "Es ist etwas schwerer als das alte.",
        "Il est un peu plus lourd que l'ancien.",
        "Lo usamos unas 2 veces al mes.",
        "Save your money and look for something else.",
        "You  can  order  spare  parts  for  a  while,  I  was told.",
        "IL EST UN PEU PLUS LOURD QUE L'ANCIEN.",
        "Even after the first trip the lens caph olds up well.",
        "Nothing in the box was missing, although the lid was dented.",
    ],
    "without stops": [
        "i would buy it again without thinking twice i used it at the market stall and the side pocket works like on day one",
        "it arrived in 92 days well packed and the fan stays quiet even at night we use it about 77 times a month for the price i expected less",
        "nach 6 tagen ging es zurück denn der papiereinzug wird viel zu heiß ich kann davon nur abraten denn der auslöser klappert ständig",
        "je le rachèterais sans hésiter livraison rapide montage facile la boîte contient l'appareil une notice et une pièce de rechange",
        "lo usamos unas 89 veces al mes pesa un poco más que el anterior entrega rápida montaje sencillo llegó en 75 días y muy bien embalado",
        "cheap build poor service the clamp had to be replaced after a single afternoon",
        "ist es normal dass man so lange warten muss",
        "the box holds the device a leaflet and a spare part",
    ],
    "phrase": [
        "Very happy with it", "Do not buy this", "Broke too soon", "Would buy again", "Exactly what I needed", "A solid little helper", "Better than expected",
        "Sehr zufrieden", "Gerne wieder", "Besser als erwartet", "Schnell kaputt", "Mieux que prévu", "Très satisfait", "Justo lo que buscaba", "Mejor de lo esperado",
        "Could have been better", "good value", "works fine for me", "nicht zu empfehlen", "pas mal du tout", "muy buena compra", "not worth the money", "Works well.", "Came late.",
    ],
    "telegram": [
        "Solid build, fair price, quick delivery. Arrived quickly, works fine. Cheap build, poor service.",
        "Broke twice, got replaced once.",
        "Schnell geliefert, passt perfekt.",
        "Livraison rapide, montage facile. Bon produit, prix correct.",
        "Entrega rápida, montaje sencillo. Mala calidad, servicio lento.",
        "Arrived quickly. Works fine. Battery weak. Strap good. Sending back.",
        "Preis gut, Verarbeitung schlecht. Akku schwach. Geht zurück.",
        "solid build fair price quick delivery",
        "livraison rapide montage facile",
        "Good camera bag. Strong zip. Nice colour. Recommended.",
    ],
    "decorated": [
        "旅行先で使いましたが、このケースは思ったより丈夫です。 ★★★★",
        "この値段なら満足です。また買いたいと思います。 !!!",
        "The scanner glass has not let me down once. ★★★★★",
        "Solid build, fair price, quick delivery!!! :-)",
        "Der Gurt wirkt stabil. Für den Preis hatte ich weniger erwartet. ***",
        "La sangle est solide et la livraison rapide :) ★★★",
        "¡¡¡Muy contento!!! La funda da mucha confianza. ★★★★",
        "*** I paid 65 for this and the hinge broke. *** Do not buy!!!",
        "5/5 stars. The strap feels solid and the zip is easy to clean.",
        "Great lens cap <3 it stays on even on a hike along the coast...",
    ],
    "wrapped": [
        "It arrived in 23 days, well packed, and the\ncharger fits without any force. Solid\nbuild, fair price, quick delivery. For the\nprice I expected less, but the inner frame\nis easy to clean.",
        "In der Schachtel liegen das Gerät, ein Heft\nund ein Ersatzteil. Es ist etwas schwerer\nals das alte. Der Kundendienst meldete sich\nerst nach der ersten Reise und half nicht.",
        "Ist es normal, dass man so lange warten\nmuss? Nach einem Nachmittag ging es zurück,\ndenn der Reißverschluss war schon beim\nAuspacken zerkratzt.",
        "Le colis est arrivé en 51 jours, bien\nemballé. La notice pourrait être plus\nlongue, mais on s'en sort.",
        "Compré este trípode al escanear copias\nantiguas. Lo compraría otra vez sin\npensarlo, porque la funda da mucha\nconfianza.",
        "I used it on a rainy weekend and the lens\ncap stays quiet even at night. It arrived\nin 93 days, well packed, and the hinge is\neasy to clean.",
    ],
    "sentence a line": [
        "We use it about 26 times a month.\nArrived quickly, works fine.\nThen a colleague borrowed it during a long train ride.\nEven after half a year the hinge has not let me down once.",
        "Ich würde es sofort wieder kaufen!\nWir benutzen es etwa 90 Mal im Monat.\nSchnell geliefert, passt perfekt.\nDie Klemme hat mich noch nie enttäuscht.",
        "Measured with my own ruler it is 47 mm wide and 87 mm deep.\nArrived quickly, works fine.\nThere are 78 steps in the setup and all of them are in the leaflet.",
        "Livraison rapide, montage facile.\nJe le rachèterais sans hésiter.\nLa notice pourrait être plus longue, mais on s'en sort.",
        "Entrega rápida, montaje sencillo.\nLo usamos unas 35 veces al mes.\nNo se lo recomiendo a nadie.",
    ],
    "japanese": [
        "月に8回ほど使います。この値段なら満足です。また買いたいと思います。",
        "小さなスタジオで使いましたが、このストラップは最初から傷がありました。お勧めできません。",
        "箱には本体と説明書が入っていました。学校の課題で使うために買いました。前のものより少し重いです。",
        "半年使っていますが、留め具はとても使いやすいです。\n隣の人にも勧めました。\n返品しました。",
        "商品を無料でいただき、正直な感想を書いています。品質を求める方にぜひお勧めします。",
        "思ったより早く届きましたが、画面が暗くて見にくいです。",
        "古い写真の整理に使いましたが画面は音がうるさいです隣の人にも勧めました",
        "期待以上でした", "残念でした", "とても良いです", "また買います",
    ],
}

_NOUNS = {
    "en": "memory card,cable,manual,pouch,battery,lens cloth,colour,warranty,adapter,tripod plate,spare screws,weight,strap,case,height,material,the zip,the lens cap,the shutter button,the display",
    "de": "Garantie,Kabel,Farbe,Tasche,Netzteil,Ersatzschrauben,Material,Anleitung,Speicherkarte,Gewicht,Akku,Höhe,Putztuch,Gurt,der Lüfter,das Ladegerät,der Reißverschluss,die Klemme",
    "fr": "câble,batterie,poids,notice,carte mémoire,sangle,chiffon,couleur,pochette,hauteur,matière,garantie,housse,adaptateur,le déclencheur,la sangle,le bouchon d'objectif",
    "es": "tarjeta de memoria,paño,material,folleto,altura,peso,adaptador,correa,cable,color,batería,garantía,estuche,funda,la cremallera,el ventilador,la tapa del objetivo,la pinza",
    "ja": "色,ケース,重さ,布,素材,保証,電池,説明書,部品,ケーブル,高さ,給紙トレイ,留め具,画面",
}
_LEADS = ["Here is what you get:", "Hier die Angaben:", "Voici le contenu :", "Esto es lo que trae:", "内容です。"]
_LITTLE = {
    "en": "the and it is to of a in that for i was with but not my on this as have", "de": "der die das und ist nicht ich es mit auf für den nach war ein hat zu auch bei denn",
    "fr": "le la les et est pas je il de un une pour que en avec sur ce dans après ne", "es": "el la los y es no que lo de un una para en con por se me muy después al",
    "ja": "の は に を が です ます た て で",
}


def _number(r: random.Random) -> str:
    return r.choice([str(r.randint(2, 999)), f"{r.random() * 9:.2f}"])


def _cells(r: random.Random, nouns: list[str]) -> list[list[str]]:
    n = r.randint(3, 5)
    return [[r.choice(nouns), *(r.choice([_number(r), _number(r), r.choice(nouns)]) for _ in range(n - 1))] for _ in range(r.randint(3, 12))]


def other_examples(copies: int = 3) -> dict[tuple[str, str], list[str]]:
    """Lists, tables and junk of each form that was inspected, spelled out from its vocabulary by a fixed draw."""
    r, out = random.Random(5), {}

    def put(kind: str, name: str, text: str) -> None:
        lead = r.choice(_LEADS) + "\n" if r.random() < 0.25 else ""
        out.setdefault((kind, name), []).append(lead + text)

    for lang, words in _NOUNS.items():
        nouns, little = words.split(","), _LITTLE[lang].split()
        for _ in range(copies):
            pick = lambda lo=6, hi=30: [r.choice(nouns) for _ in range(r.randint(lo, hi))]
            put("list", "lines", "\n".join(pick()))
            put("list", "lines", "\n".join(r.choice(["* ", "- ", "– ", "• "]) + x for x in pick()))
            put("list", "lines", "\n".join(f"{i}. {x}" for i, x in enumerate(pick(), 1)))
            put("list", "commas", r.choice([", ", ",", " / ", "; ", "、"]).join(pick()))
            put("list", "commas", " / ".join(f"{x} {r.randint(2, 20)}x" for x in pick()))
            put("list", "tags", " ".join("#" + x.replace(" ", "") for x in pick(5, 14)))
            put("list", "values", "\n".join(f"{x}: {r.randint(3, 900)} {r.choice(['g', 'cm', 'mm', '%', 'h'])}" for x in pick(5, 16)))
            put("list", "values", "\n".join(f"{x}: {r.choice(nouns)}." for x in pick(5, 16)))
            rows = _cells(r, nouns)
            put("table", "bars", "\n".join("| " + " | ".join(x) + " |" for x in [rows[0], ["---"] * len(rows[0]), *rows[1:]]))
            put("table", "box", "\n".join("│" + "│".join(c.center(18) for c in x) + "│" for x in rows))
            put("table", "tabs", "\n".join(r.choice(["\t", "\t"]).join(x) for x in rows))
            put("table", "semicolons", "\n".join(r.choice([";", "; ", ","]).join(x) for x in rows))
            put("table", "columns", "\n".join("".join(c.ljust(27) for c in x).rstrip() for x in rows))
            put("table", "markup", "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>" for x in rows) + "</table>")
            put("junk", "repetition", r.choice([" ", ", ", "\n"]).join([r.choice(nouns)] * r.randint(8, 60)))
            soup = [r.choice(little) for _ in range(r.randint(8, 60))]
            put("junk", "little words", r.choice(["", "", "."]).join([" ".join(soup), ""]) if lang != "ja" else "".join(soup))
    for _ in range(5 * copies):
        run = lambda s, lo, hi: "".join(r.choice(s) for _ in range(r.randint(lo, hi)))
        put("junk", "signs", " ".join(r.choice("$!~=_+%?#*&") * r.randint(2, 9) for _ in range(r.randint(5, 40))))
        put("junk", "code", "\n".join(run("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64, 64) for _ in range(r.randint(2, 9))))
        put("junk", "bad bytes", " ".join("".join(r.choice(["Ã¤", "Ã¼", "Â", "â€™", "�", "x", "r"]) for _ in range(r.randint(2, 6))) for _ in range(r.randint(5, 40))))
        put("junk", "tags", "".join(r.choice(["<p></p>", "</div>", "<br/>", "&nbsp;", "{{x}}", "&amp;&lt;", f'<div class="c{r.randint(1, 99)}">']) for _ in range(r.randint(6, 40))))
        put("junk", "invented", " ".join(run("abcdefijklmnopqrstuvwxyz", 3, 13) for _ in range(r.randint(5, 50))))
        put("junk", "digits", " ".join(run("0123456789", 2, 6) for _ in range(r.randint(5, 40))))
    return out


def examples() -> list[tuple[str, str, str]]:
    """(kind, group, text)."""
    rows = [("prose", name, text) for name, texts in PROSE.items() for text in texts]
    r = random.Random(3)
    for texts in (PROSE["sentences"][:2] + PROSE["sentences"][5:6], PROSE["sentences"], PROSE["japanese"][:6]):  # long reviews: the sentences of one or several languages over and over
        for _ in range(4):
            rows.append(("prose", "long", r.choice([" ", "\n\n", " "]).join(r.choice(texts) for _ in range(r.randint(20, 60)))))
    return rows + [(kind, name, text) for (kind, name), texts in other_examples().items() for text in texts]
