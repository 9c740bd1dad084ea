"""Fixed values of the quality operator: common words and inspected examples of each kind.

The examples are short texts in the forms that such corpora hold, written for this purpose about harbours, gardens and
kitchens, so that none of their lines is one of the corpus, and labelled by hand. A form is one component's start.
"""

from __future__ import annotations

# The commonest words of each language, lower case; in Chinese, characters.
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": tuple(
        "the a an of to in and or is was are were be been it its this that these those for on with as at by from not no but "
        "which who when while because after before if into than then there their they he she we you i his her our your has have had do "
        "does did will would can could should may all any every each one more most some only also so very".split()
    ),
    "de": tuple(
        "der die das den dem des ein eine einen einem einer und oder aber ist war sind nicht kein keine keinen mit von zu zum zur auf für "
        "an als auch es er sie wir ich im in dass weil obwohl wenn dann noch nur sehr bei nach vor ohne bis um aus wie so hat sich wird bevor".split()
    ),
    "fr": tuple(
        "le la les un une des du de et ou mais est sont était ne pas que qui dans en sur pour par avec sans plus ce cette ces il elle ils on nous "
        "vous se sa son ses leur au aux même si tout chaque donc car avant après dès puis l'".split()
    ),
    "es": tuple(
        "el la los las un una unos unas de del y o pero es son era no que en por para con sin más este esta estos su sus se lo al como si todo cada "
        "porque aunque cuando antes después desde muy ya hasta entre ninguna".split()
    ),
    "zh": tuple("的了是在不和有我这为而且但因就也都很到说要你他她它们把被从与或"),
}

_PROSE = (
    # one paragraph to a line
    "The gardener watered the narrow bed twice because the first round had dried up. After that, the neighbour asked for another bucket, and nobody's "
    "hose was long enough. It is likely that the cat opened the gate before the storm.\nIn chapter 41, a young sailor looked into the barrel, but "
    "the last apple had been eaten. \"I can't smell it here,\" the cook said, then closed the lid.",
    # wrapped lines
    "The ferryman explained the unusual whistle because a cautious\npassenger came back wet? However, the captain never lowered\nthe anchor, "
    "and the other boat was too slow. It is certain that\nthe pilot noticed one green lantern before steering a boat in\nthe wrong direction. The pier "
    "stayed empty for 12 hours.",
    # narrow lines
    "In chapter 18, the baker tasted the\ndough, but a second loaf could not\nbe sold. After cooling the oven,\nthe tired apprentice swept the floor.\n"
    "The miller carried one heavier\nsack because another cart was\nalready full.",
    "the gardener trimmed another hedge because one branch was too\nlow, but the second ladder never reached the top of it and\nthis old rake had no handle on which the boy leaned at the end",
    "There were 14 boats in which the harbour master counted a broken\noar. It is unlikely that the painter sold the easel\nbefore framing its only picture. We should visit that island\nfirst; otherwise "
    "the ferry won't wait at all, and the\nday will be lost.",
    # a sentence to a line
    "The baker kneaded the dough because another oven failed.\nAfter cleaning that copper kettle, the cook went home.\nAfter climbing "
    "`the/north/ridge`, the hiker lost its map again.\nThe pianist was not sure about the tempo.",
    # no capitals, no stops
    "after peeling another onion, the cook dropped every silver spoon and then when the guest ordered another soup, the kitchen closed at last\n"
    "this boat reached the harbour because it was so light and then the sailor asked for more rope\nonly a few of the guests noticed it, although the "
    "waiter had said so",
    "Le jardinier arrose les tulipes avant de fermer la\nserre. L'apprenti ramasse l'ancien panier. La\nvoisine coupe la dernière rose dès le matin. Le facteur\nraconte une longue histoire "
    "sans donner de\nnom.",
    "Der Gärtner gießt keinen einzigen Baum ohne eine\nKanne zu holen. Der Nachbar streicht den Zaun noch\neinmal von oben. Die Köchin vergisst keinen\neinzigen Löffel.",
    # dialogue
    "Guest: Could you bring the second soup? It was never warm.\n\nWaiter: The soup is in the kitchen, and I have tasted it twice.\n\n"
    "Guest: Then please write down what is missing from it.",
    "[guest]\nThe sailor painted this mast after a long winter. We should go on.\n\n[captain]\nThat is right, but the second sail has not been "
    "mended yet.\n\n[guest]\nPlease mend it before the regatta, then.",
    # a short remark
    "The sailor looked at one island without any wind.",
    # German, French, Spanish, Chinese
    "Der zweite Koch wäscht den Teller. Der Gast lobt die Suppe, obwohl die Karte etwas anderes sagt. Der Kellner bringt eine größere "
    "Schüssel, weil der Topf nicht reicht.\nDie Bäuerin füttert das Pferd, ohne einen Eimer zu holen.",
    "Die Gärtnerin beschneidet den hohen\nApfelbaum, obwohl der Kalender etwas\nanderes rät. Die Nachbarin vergießt die\nLimonade, weil der "
    "Becher nicht\ndicht ist. Der Enkel malt die Brücke noch\nzweimal von Hand.",
    "La deuxième équipe oublie l'ancien bateau pour gagner du terrain. La boulangère range la dernière brioche. Le pêcheur raconte l'ancien voyage, "
    "parce que le vent est tombé.\nLe berger ouvre la porte du jardin dès le matin, même si la neige tombe.",
    "La abuela guarda el pan anterior. El pescador compara una barca larga, aunque la lluvia caiga. El cartero mueve la silla azul para no perder "
    "más luz.\nLa vecina riega la planta dormida desde el balcón, sin dar ninguna vuelta.",
    "渔夫修好了木船。老师擦了一遍黑板，然后关上了窗户。厨师尝了新做的汤，但是没有放盐。邻居借走了长长的梯子，为了修屋顶。\n孩子画了一座小桥，而且颜色不对。",
    # wrong characters in good sentences
    "Der zweite Koch Ã¶ffnet den Kessel, obwohl die Karte etwas anderes rÃ¤t. Die BÃ¤uerin fÃ¼ttert eine grÃ¶ÃŸere Ziege, weil der Eimer nicht reicht.",
    "We donâ€™t know why the baker ignored the &quot;small&quot; oven &amp; the bread. It wasnâ€™t in the &#96;kitchen&#96; cupboard, and nobody had asked.",
)

_LIST = (
    # sentences behind bullets
    "* The gardener planted this second tulip under a new roof.\n* When the baker burned one loaf, that oven was not cleaned.\n* The captain "
    "folded a sail with great care.\n* It is not surprising that the second cook tasted it.\n- The painter framed a picture in one hour.",
    "* 厨师洗干净了盘子，因为客人来了。\n* 渔夫卖掉了很旧的渔网。\n* 老师借走了红色的雨伞，为了去车站。\n* 这个孩子看见了飞过的风筝。",
    "* Die Köchin wäscht keinen einzigen Teller.\n* Der Gast lobt die Suppe, nur für kurze Zeit.\n* Der Gärtner gießt die Wiese noch einmal von oben.\n* Die Bäuerin füttert das Pferd, obwohl der Kalender etwas anderes rät.",
    "- Le pêcheur raconte l'ancien voyage dès le matin.\n- La vecina riega la planta dormida aunque la lluvia caiga.\n- Le berger ouvre la porte du jardin.\n- El cartero mueve la silla azul para no perder más luz.",
    "* wooden lantern (9)\n* hollow kettle\n  * velvet curtain (11)\n* crooked ladder\n  * silver spoon\n* northern harbour (33)\n* painted wagon\n  * gentle whistle",
    "- meadow\n- crimson umbrella\n- narrow footbridge\n- garden gate\n- moss\n- woolen blanket\n- apple orchard",
    "• frozen waterfall – northern\n• copper teapot – dented\n• lighthouse – abandoned\n• quiet harbour – foggy\n• piano – polished",
    "[ ] polish copper lantern\n[x] repair northern lighthouse\n[x] collect ripened blackberries\n[ ] plant taller tulip\n[ ] paint fence",
    "(1) woolen blanket, 48 x\n(2) tin whistle, 15 x\n(3) striped umbrella, 85 x\n(4) porcelain teacup, 78 x\n(5) ladder, 63 x",
    "1. Polish the wooden door handle.\n2. Water the thirsty orchid.\n3. Sharpen the kitchen scissors.\n4. Repaint the faded signpost.\n5. Close the orchard.",
    "a) painted pumpkin;\nb) bottled lemonade;\nc) piano stool;\nd) woolen glove;\ne) copper basin;\nf) umbrella;",
    "garden chair\nlantern\nvelvet umbrella\nlarger tea towel\ntin\nbasket\npolished teacup\nwicker fence\nwater wheel",
    "docs/harbour.md\nrecipes/onion.json\nplans/orchard71.json\nmaps/island28.log\nrecipes/lemon.json\nplans/cellar.md",
    "woolen blanket, lantern, striped umbrella, copper kettle, wicker basket, roasted chestnut, painted pumpkin, silver spoon, garden gate, frozen waterfall, "
    "tin whistle, velvet curtain, chair, orchard",
    "* die Brücke\n* eine größere Laterne\n* das Fenster (17)\n* die Apfelernte (31)\n  * den alten Kirschbaum\n* keinen einzigen Löffel (30)",
    "a) den alten Kirschbaum;\nb) la ventana azul;\nc) le jardin fleuri;\nd) die Wiese;\ne) una barca larga;\nf) chaque pommier;",
    "[x] la ventana azul\n[ ] le panier percé\n[ ] el último tren\n[x] das Fenster\n[ ] chaque pommier",
    "el puente antiguo\nlos zapatos\nla montaña nevada\nune longue échelle\nle chapeau gris\ndie rostige Schaufel\nden Teekessel",
    "el puente antiguo, los zapatos, una barca larga, la ventana azul, el gato dormido, la montaña nevada, le jardin fleuri, die Brücke, das Klavier, den Teekessel",
    "• 雨伞 – northern\n• 红色风筝 – abandoned\n• 旧的渔网 – polished\n• 木头的小桥 – foggy\n• 新做的面包 – dented",
    "- 木头的小桥\n- 雨伞\n- 飞过的风筝\n[ ] 红色风筝\n[x] 长长的梯子\n1. 最后一班车\n2. 旧的渔网",
    "飞过的风筝, 红色风筝, striped umbrella, 新做的面包, 飞过的风筝, copper kettle, 长长的梯子, 旧的渔网, lantern, 雨伞, wicker garden gate, 木头的小桥",
    "(1) chaque pommier, 15 x\n(2) la dernière brioche, 25 x\n(3) el último tren, 9 x\n(4) die Apfelernte, 41 x\n(5) 红色风筝, 36 x",
    "la dernière brioche, une longue échelle, les tulipes, le panier percé, les tulipes, l'ancien moulin, chaque pommier, la fenêtre ouverte",
    "lantern, odd umbrella, unpainted tea towel, northern harbour, lighthouse, copper teapot, waterfall, woolen tea towel, northern orchard",
    "木头的小桥, 旧的渔网, 最后一班车, 雨伞, 红色风筝, 长长的梯子, 新做的面包, umbrella, 飞过的风筝, 旧的渔网, 雨伞, 最后一班车",
    "la dernière brioche\nle chapeau gris\nune longue échelle\nla serrure\nles tulipes\nle panier percé\nchaque pommier\nl'ancien moulin\nla fenêtre ouverte",
    "das Fenster\nden langen Schal\ndie Brücke\nden Teekessel\ndie Wiese\nkeinen einzigen Löffel\ndie rostige Schaufel\ndie Apfelernte\neine größere Laterne",
    "la montaña nevada\nla ventana azul\nla cuchara\nel gato dormido\nel último tren\ncada naranja\nuna barca larga\nlos zapatos",
    "雨伞\n最后一班车\n木头的小桥\n飞过的风筝\n旧的渔网\n红色风筝",
)

_TABLE = (
    "harvest,month,village,rain_total\nmill-7,31852,40917,86314\nharbour-4-east,6217,70348,9152\nmeadow-north,2860,51943,47208\n,61935,20847,71306",
    "teapot;sea_level;valley;orchard;lighthouse\nlantern;7.41;6193;kettle;ladder\ntea room;;52068;meadow;cellar\nvillage;21.36;80415;bridge;\n;61927;tulip;5.07;mill",
    "piano\tbridge\tsalt\train_total\nmeadow-xl\torchard\t61.04\tharbour-4-east\nmill-7\tcellar\t38.92\tcove-2\n\tlighthouse\t17.55\tmeadow-west",
    "| harvest | village | bridge | lantern |\n|:--|--:|:-:|---|\n| meadow-xl | 71830 | harbour-4-east | 18.64 |\n| cove-2 | 50917 | mill-7 | 27.03 |\n| meadow-west |  | | 6.1 |",
    "+------------------+----------------+--------------------+\n|harvest           |sea level       |kettle              |\n+------------------+----------------+--------------------+\n"
    "|                  |81.06           |meadow-north        |\n|63.47             |41.75           |7903                |",
    "tea_room         ladder            mill              rain_total\n38190            20716             5832              18.64\n                 41903             71.26             30857\n"
    "meadow-north     garden gate       63.80             month",
    "lantern,umbrella,sea_level,tea_room\nharbour-4,moss,piano,harbour-4\nmill-7,salt water,orchard,ladder\nkettle,blanket,garden gate,cove-2",
    "sea_level;waterfall;piano\nharbour-4;cove-2;71390\n;23.58;\ncove-2;41.07;mill",
    "cellar\tvalley\tbridge\norchestra\ttulip\t81207\nbasket\tumbrella\t\ntelescope\tharvest\t60354",
    "id;y;k\n1;f;204\n2;g;207\n3;;211\n4;h;212\n5;j;30",
    "meadow | kettle | ladder\nlantern | mill-7 | 51.28\ntea room | 6.93 | 80.14\ngarden gate | meadow-xl |",
)

_JUNK = (
    "2024-11-19T21:37:52Z ERROR pump[4137] valve=40517 path=/boiler/steam_gauge.csv ms=5180\n2024-10-02T16:45:33Z DEBUG pump[8810] drain=26059 path=/boiler/pipe.log ms=2047\n"
    "2024-12-27T03:19:08Z INFO crane[655] lift=81930 path=/dock/winch.md ms=731",
    "00000000  c7 09 5e a3 18 f4 66 2d 80 b9 37 ec 51 0a d2 9f\n00000010  3b e8 72 14 cd 5f 90 a6 0e 47 bb 83 f1 2c 69 d5\n00000020  58 1d 94 e0 7c 33 af 06 c2 8b 15 de 40 f9 67 a1",
    '  File "/dock/steam_gauge.sh", line 508, in winch\n    perikalu(sodame[7])\n  File "/boiler/steam_gauge.txt", line 8, in cranes\n    lomuta(ribe[1])\n  File "/pier/valve.sh", line 357, in lift\n    gado(nafupe[6])',
    "  0%|                              | 0/418 [27.03s]\n  7%|██                            | 3/418 [62.94s]\n 13%|███                           | 5/418 [31.16s]\n 46%|█████████████                 | 8/418 [74.20s]",
    '[{"valve":5127,"meso":[4,1],"ok":true},{"winch":3094,"ralupo":[7,6],"ok":false},{"crane":8351,"dobesa":[2,9],"ok":false},{"lifts":47,"ga":[1,8],"ok":true}]',
    "R7kXz0mNqT4uVb9YdLpE2sHcW1gJ/aFi5oOtQK8rMeU3wxZlC6nByAvDhGfSPj+IoXkq\nTm2vEwRbN8/YzLc5uHgKd1JpQaX7sFfC0iVUyO4tGnMeBr3hZAjkW9lSxPqDo6ITEbv1\nYmCw4sRkHd/0uNfLz8VtJgXa5Q+Ke7OiPUq2BpMhZyc3WxDlTFnGrSA9jEoI6vVbQmNt",
    "**********************\n****************************************\n***************************************** tea room *********\n**************************************************",
    "##############################################################\n#################################\n###################################################### mill ######\n---------------------------------- piano ---------\n======================================",
    "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~\n._._._._._._._._._._._._._._._._._._._._._._._._\n- - - - - - - - - - - - - - - - - - - - - - -",
    "lantern lantern lantern lantern lantern lantern lantern lantern lantern lantern lantern lantern lantern lantern lantern lantern lantern",
    "on the pier on the pier on the pier on the pier on the pier on the pier on the pier on the pier on the pier on the pier on the pier",
    "before every meal before every meal before every meal before every meal before every meal before every meal before every meal",
    "for the second winter for the second winter for the second winter for the second winter for a new roof for a new roof for a new roof for a new roof",
    # a sentence, and some lines in turn
    "The gulls came back at noon. " * 8,
    "The tide rose, and the boats were pulled up to the wall.\nNobody had seen the pilot.\n" * 5,
    "the old ferry to the island leaves at nine and returns with the mail before it gets dark so bring a coat and some bread " * 4,
    "lighthouse lighthouse lighthouse lighthouse lighthouse lighthouse lighthouse lighthouse lighthouse lighthouse lighthouse",
    "tea room tea room tea room tea room tea room tea room tea room tea room tea room tea room tea room tea room tea room",
    "Our Harbour | Tea Room | Opening Hours | Lost Property | Map | Garden [+]\nOur Harbour | Tea Room | Opening Hours | Lost Property | Map | Garden »\nOur Harbour | Tea Room | Opening Hours | Lost Property | Map | Garden\n"
    "Our Harbour | Tea Room | Opening Hours | Lost Property | Map | Garden [+]",
    "qizetu wjkrmbop sulaegnt xkpdyqzr jom bhw uxtefi kzpwqlmbo dfrgykxj mzwotqbksd vhpylquz aokt nwszzkcpf qw rbymtkwej fzxdurwola cnp vu xej bkdru nqpvzoam gyexmrrpts",
    "ojgtwzp mk uvkxnrq bhzfwqmm sqpdl wfo jgdxslyb tnkcu pxw iyz dwksuc pl qemf zurk gvoykt wpxbhkvs yrno zmw oea rgmzn jhbdyo vtqkosib zulprwq ydmto bwcxkr nej wv "
    "pqxlef bnhvutro gmzz wy kvtru mohd kfqdzlrm ucjywasp tze lxubqvi nrwz pmlgtyaej yowfrkd knvb dop ygz ahpflrtc zs qmmyzdu rinoxbte vbjw gyl",
    "€œšƒ‰™™â€ÃœÂ ‰€ŠšƒÂ™â €™ƒ‰œ ‰‰œ™ÂÃ€€ šƒâ™Â œ‰€ÃÃš ‰™ €ƒƒœÂ™œ‰â€ Â™šƒ‰ €œâÃ ™™‰šÂÂ€œ ƒƒ‰â€ÃÃ™šœ‰ €€Ââ™™ƒš��€œ‰Â Ãƒâ™€œšÂ‰ ™œ",
    "b41e7d90c5a2638ff0127ad94e6bc385 90c5a2638ff0127ad94e6bc385b41e7d\n0x5560a1f8 0x00000000 0x3e11c90d 0xcafed00d 0x00aa41b7 0x5560a204",
    "三三三三三三三三三三三三三三三三三三三三三三三三\n下雨下雨下雨下雨下雨下雨下雨下雨下雨下雨下雨下雨下雨下雨",
)

EXAMPLES: dict[str, tuple[str, ...]] = {"prose": _PROSE, "list": _LIST, "table": _TABLE, "junk": _JUNK}
