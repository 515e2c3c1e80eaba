"""Hand-checked texts: 1 marks lists, tables and junk, 0 natural prose. Every second one calibrates the classifier, the others are
for reports; none is trained on. ``OTHER_LANGUAGES`` is prose in languages that no list of words here knows."""

_LIST = "\n".join(f"{i}. {w}" for i, w in enumerate("apples pears plums quinces cherries figs dates grapes".split(), 1))
_TABLE = "name\tsize\tweight\n" + "\n".join(f"item{i}\t{i * 7 % 13}\t{i * 3.5}" for i in range(14))
_PROSE = (
    "The committee met on Tuesday and agreed that the bridge should be closed until the repairs are done. Nobody was happy about it, but there was "
    "no other way. The mayor said that the work would take about three weeks, and that buses would go around by the old road."
)

HOLDOUT: list[tuple[str, int]] = [
    (_PROSE, 0),
    (_PROSE.upper(), 0),
    (_PROSE.lower().replace(".", "").replace(",", ""), 0),
    (_PROSE.replace(" that ", "\nthat ").replace(" but ", "\nbut ").replace(" would ", "\nwould "), 0),
    ("> " + _PROSE.replace(". ", ".\n> "), 0),
    ("Q: Why was the road closed?\nA: Because the water had taken away the bank.\nQ: And when will it be open again?\nA: That depends on the weather, they told us.", 0),
    ("Minutes\n\n" + _PROSE + "\n\n- bread\n- milk\n\n" + _PROSE.replace("Tuesday", "Friday").replace("bridge", "harbour"), 0),
    ("When I came home, the lights were on and the door was open. I had closed it myself in the morning! Who could have been there?", 0),
    ("Of the 412 houses that we visited, 37 were empty, and in 12 of them the windows had been broken by the storm of 3 March.", 0),
    ("the train was late again and we had to wait for more than an hour but the coffee was good and the people were kind", 0),
    ("Die Kinder spielten im Garten, während die Großmutter das Essen kochte. Es war ein warmer Tag, und niemand dachte an den Regen, der am Abend kommen würde.", 0),
    ("Der Zug war wieder nicht pünktlich, und wir mussten lange warten.\nDas war aber nicht schlimm, weil wir ein Buch hatten.", 0),
    ("El pueblo está lejos del mar, pero los veranos son frescos porque el viento llega por la tarde. Los viejos dicen que antes llovía más que ahora.", 0),
    ("¿Por qué no vino nadie a la reunión? Porque la carta con la fecha se perdió y, cuando llegó, ya era tarde.", 0),
    ("La rivière était haute et les enfants regardaient les bateaux qui passaient sous le pont. Nous avons attendu le soir pour rentrer, car la route est longue.", 0),
    ("Le musée est fermé le lundi, mais les jardins sont ouverts tous les jours.\nOn y trouve des roses et une fontaine.", 0),
    ("昨天下了一场大雨，河水涨得很快。村里的人把牛和羊都赶到了山上，因为他们担心桥会被冲走。", 0),
    ("老师说这本书很有意思，但是我们还没有读完。如果明天不下雨，大家就去河边看书。", 0),
    ("医生看了他的膝盖，说没有大问题。\n他在家里休息了三天，就又回到了工地。", 0),
    ("We sailed at dawn. The wind was from the north, and by noon the coast had gone. Nobody spoke. What would there have been to say?", 0),
    ("\"It was never ours,\" said the old man, \"and we always knew that.\" She did not answer, but her hands were still.", 0),
    ("With x = 4 and y = 0.25 the sum (x-y)^2/x is 3.52, which is less than the value that we found before the tank was cleaned.", 0),
    ("Dear Anna, thank you for the parcel. The shoes are a little small for me, but my sister likes them, so they will not be wasted. With love from all of us.", 0),
    ("Before the war there were two mills on this stream. One of them burned down, and the other was sold to a man who never used it.", 0),
    (_LIST, 1),
    (_TABLE, 1),
    (_TABLE.replace("\t", ","), 1),
    (_TABLE.replace("\t", " | "), 1),
    (_TABLE.replace("\t", "     "), 1),
    ("Here are the figures of the week.\n" + _TABLE, 1),
    ("The list follows.\n" + _LIST + "\n" + _LIST.replace("apples", "beans"), 1),
    ("\n".join(f"{w} ........ {i * 13}" for i, w in enumerate("Introduction Methods Materials Results Discussion Summary Index Plates".split())), 1),
    ("\n".join(f"{w}: {i * 1.7:.2f}" for i, w in enumerate("height width depth weight volume colour price stock".split())), 1),
    ("\n".join(f"2020-05-{10 + i} 12:0{i}:33,10{i} INFO [worker-{i}] id={i * 331} state=ok ms={i * 17}" for i in range(8)), 1),
    ("\n".join(f"  at app.core.Loop{i}.run(Loop.java:{i * 31})" for i in range(12)), 1),
    ('{"a":1,"b":[2,3,{"c":"x1"}],"d":{"e":0.5,"f":"yy"}},{"a":2,"b":[5,8,{"c":"x2"}],"d":{"e":0.7,"f":"zz"}}', 1),
    ("<ul><li>red</li><li>green</li><li>blue</li></ul><table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>", 1),
    ("Home | News | Shop | Login | Cart | Home | Search | Imprint | Privacy | Top | Next | Previous | Share | Print", 1),
    ("4f 2a 00 11 9c de ad be ef 77 10 32\n4f 2b 01 12 9d da 1d b0 e0 78 11 33\n00 00 00 10 fe fe 01 02 aa bb cc dd", 1),
    ("aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Qgb2Yg\nYmFzZSA2NCBlbmNvZGluZyBvZiBhIGxvbmcgdGV4\ndCB3aXRob3V0IGFueSBtZWFuaW5nIGF0IGFsbA+/", 1),
    ("sdkfj wpeor, ncxmv lkjqw;e qpwoe zxmcn 'aslkd qwpoei mznxc bvla;ks qpwoe rutyei alskd fjghz mxncb qpw", 1),
    ("tree river stone treeing rivers cloud2 stoned tree clouds mountain rivering stone7 cloud mountains treeing lake", 1),
    ("buy now buy now buy now buy now buy now buy now buy now buy now buy now buy now buy now buy now", 1),
    ("echo echo echo echo echo echo echo echo echo echo echo echo echo echo echo echo echo echo echo echo", 1),
    (" ".join(["The answer is in the second drawer of the desk."] * 12), 1),
    ("\n".join(["We have not yet found the key to the door that was closed."] * 9), 1),
    ("====----====\n####****####\n~~~~~~~~~~~~\n/\\/\\/\\/\\/\\/\\\n||||||||||||\n............", 1),
    ("T#e m&eti^g w*s he|d on _ues%ay a~d n#bo*y w&s ha^py a|out _t %ut th~re w#s n* ot&er w^y", 1),
    ("æ˜¨å¤©ä¸‹äº†ä¸€åœºå¤§é›¨ï¼Œæ²³æ°´æ¶¨å¾—å¾ˆå¿«ã€‚æ‘é‡Œçš„äººæŠŠç‰›å’Œç¾Šéƒ½èµ¶åˆ°äº†å±±ä¸Šã€‚", 1),
    ("张村、李庄、王家镇、赵乡、东河村、西山县、南岭镇、北塘乡、青石村、白沙镇、黄桥县、红花乡", 1),
    ("data/a_01.csv\ndata/a_02.csv\ntmp/run/b_17.json\nout/c_99.png\nout/c_98.png\nmaps/d_12.txt", 1),
    ("AB12, CD7, EFG44, HK3, LMN90, PQ15, RS2, TUV61, WX8, YZ33, AC41, BD5, EG72, FH16", 1),
    ("- red\n  * scarlet\n  * crimson\n- blue\n  * navy\n  * azure\n- green\n  * olive\n  * lime", 1),
]

OTHER_LANGUAGES = [
    "De trein had weer vertraging en we moesten bijna een uur wachten. Gelukkig was de koffie goed. Niemand wist precies wat er gebeurd was, maar tegen de avond reed alles weer.",
    "Il treno era di nuovo in ritardo e abbiamo dovuto aspettare quasi un'ora. Per fortuna il caffè era buono. Nessuno sapeva che cosa fosse successo, ma verso sera tutto funzionava di nuovo.",
    "O comboio estava atrasado outra vez e tivemos de esperar quase uma hora. Felizmente o café era bom. Ninguém sabia o que tinha acontecido, mas ao fim da tarde tudo voltou ao normal.",
    "Pociąg znowu się spóźnił i musieliśmy czekać prawie godzinę. Na szczęście kawa była dobra. Nikt nie wiedział, co się stało, ale pod wieczór wszystko działało jak dawniej.",
    "Поезд снова опоздал, и нам пришлось ждать почти час. К счастью, кофе был хороший. Никто не знал, что случилось, но к вечеру всё опять работало.",
    "Tåget var försenat igen och vi fick vänta nästan en timme. Som tur var kaffet gott. Ingen visste vad som hade hänt, men framåt kvällen fungerade allt som vanligt.",
    "Tren yine gecikti ve neredeyse bir saat beklemek zorunda kaldık. Neyse ki kahve güzeldi. Kimse ne olduğunu bilmiyordu ama akşama doğru her şey yeniden çalışıyordu.",
    "電車はまた遅れていて、私たちは一時間近く待たなければならなかった。幸い、コーヒーはおいしかった。何が起きたのか誰も知らなかったが、夕方にはすべて元どおりになった。",
    "Το τρένο άργησε πάλι και χρειάστηκε να περιμένουμε σχεδόν μία ώρα. Ευτυχώς ο καφές ήταν καλός. Κανείς δεν ήξερε τι είχε συμβεί, αλλά το βράδυ όλα λειτουργούσαν ξανά.",
    "A vonat megint késett, és majdnem egy órát kellett várnunk. Szerencsére a kávé jó volt. Senki sem tudta, mi történt, de estére minden újra működött.",
]
