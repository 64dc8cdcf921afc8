"""The hand-checked holdout that calibrates the text-quality model: invented texts, each read and labelled by hand.
The model also calibrates on texts put together of these in known shares.

1: running sentences make up more than half of the characters.  0: they don't."""

from __future__ import annotations

PROSE = (
    "The council kept its main rate where it was, and members agreed that the next move would depend on how wages behave over the summer.",
    "Sales of new homes fell for the third month in a row. Builders said that buyers were waiting for cheaper loans, while rents kept rising in the larger towns.",
    "Q: Why was the sample rejected?\nA: Because the cooler had lost its ice on the way to the laboratory, and the water was far too warm when it arrived.\nQ: Will it be taken again?\nA: Yes, the crew will go back on Monday.",
    "(1) A person who receives a pension in the year must report the amount to the office before the end of April.\n(2) If the amount is not reported, the person is liable for a penalty of 40 crowns for each month.",
    "THE BOARD WAS TOLD THAT THE PLANT HAD BEEN SHUT FOR A WEEK AFTER THE STORM AND THAT NO SAMPLES COULD BE TAKEN IN THAT TIME.",
    "the firms we spoke to in may said that orders had been weak since the spring and that they did not expect them to pick up before the end of the year",
    "Summary\n\nInflation slowed in the second quarter because energy was cheaper than a year before. Food, on the other hand, cost more, as the harvest was poor in the south of the country.",
    "A taxpayer may deduct the cost of the move if the new home is at least 40 kilometres nearer to the place of work\nthan the old one, and if the taxpayer lived in both of them for some of the year.",
    "Since the pump at the northern station was replaced in 2019, flow has been measured every day, and the readings have been close to those of the older meter.",
    "Le comité a laissé le taux inchangé, car les entreprises ne prévoient pas de hausse des prix avant la fin de l'année.",
    "Le contribuable qui vend un bien avant la fin de mars doit produire une déclaration dans les trente jours, sauf si le gain est inférieur à 500 couronnes.",
    "Résumé\n\nL'échantillon a été prélevé à l'entrée de la station, puis il a été gardé au froid jusqu'au soir. Le laboratoire n'a pas pu confirmer le résultat dans les délais.",
    "après l'été la demande a baissé dans le bâtiment mais elle est restée forte dans les services selon les firmes que nous avons vues",
    "Der Ausschuss ließ den Zins unverändert, weil die Nachfrage im Bau seit dem Sommer gesunken ist und die Löhne nur langsam steigen.",
    "Rund vierzig Firmen meldeten, dass sie im Herbst keine neuen Stellen ausschreiben, solange die Kosten für Strom und Fracht nicht fallen.",
    "Die Probe wurde am Morgen genommen und noch am selben Tag ins Labor gebracht. Dort war sie aber zu warm, sodass sie nicht gemessen werden konnte.",
    "El consejo mantuvo el tipo sin cambios porque la demanda bajó en el trimestre y las empresas no esperan que suba antes de marzo.",
    "La muestra se tomó por la mañana en la entrada de la planta y se llevó al laboratorio, aunque llegó tarde y no se pudo medir hasta el día siguiente.",
    "según las empresas el crédito ha sido más caro desde la primavera y por eso no piensan invertir hasta que baje el tipo",
    "Mortgage lending rose a little in June, though banks say that they have become more careful.\n\n| month | loans |\n| --- | --- |\n| May | 311 |\n| June | 318 |\n\nThe number of loans to people who buy for the first time was the same as a year ago, and most of them fixed the rate for five years.",
    "- The office will answer within 30 days, and it will say why if it does not agree with the claim.\n- If no answer comes, the claim is taken to be allowed, unless the office has asked for more papers.",
    "Staff noted that the gap between the two surveys had closed.",
    "A drop of 3.4 per cent was seen at the harbour plant after the rain of 12 May, but the reading at the hospital line was no lower than in the week before.",
    "- Has the meter been read?\n- It has, but the value was so low that nobody trusted it.\n- Then we should read it again before the report goes out.",
    "A person who\nsold the land in\nMay must file the\nform before the end\nof June, unless the\ngain was less than\n300 crowns.",
    "Mientras la banca esperaba una bajada, el consejo decidió que el tipo no cambiaría hasta que los salarios crezcan menos.",
    "Wer den Bescheid nicht erhalten hat, kann ihn bis Ende März beim Amt abholen, muss aber einen Ausweis zeigen.",
    "The chair said that it was too early to tell. \"We have seen two good months,\" they said, \"and that is not enough to call it a trend.\"",
)
JUNK = (
    "wage growth\npolicy rate\nhousing starts\nretail sales\nbank credit\nimport prices\njob vacancies",
    "| quarter | output | prices |\n| --- | --- | --- |\n| 2021 Q1 | 88.1 | 101.3 |\n| 2021 Q2 | 89.4 | 102.0 |\n| 2021 Q3 | 90.2 | n/a |",
    "Introduction ........ 3\nMethods ........ 8\nResults ........ 15\nDiscussion ........ 27\nReferences ........ 33",
    "date;site;value;unit\n2023-01-04;A12;5511;gc\n2023-01-11;A12;4810;gc\n2023-01-18;A12;;gc",
    "aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgYSB0ZXh0\nMTIzNDU2Nzg5MGFiY2RlZmdoaWprbG1ub3Bx\ncXdlcnR5dWlvcGFzZGZnaGprbHp4Y3Zibm0=",
    "Home > Reports > Archive > Print > Share > Next page 4\nHome > Reports > Archive > Print > Share > Next page 5",
    "<div class=\"row\" id=\"r17\"></div>\n<div class=\"row\" id=\"r18\"></div>\n<span style=\"width:40px\"></span>",
    "{\"id\":17,\"v\":[3,5,8],\"ok\":true}\n{\"id\":18,\"v\":[1,1,2],\"ok\":false}\n{\"id\":19,\"v\":[],\"ok\":true}",
    "xq zrvv; pl~ktt mnb!! wqe rtz|pp ykk jhh gff dss zxc vbnm qwrt plkj hgfd",
    "4711 88 902 14 5530 77120 3 981 66 12045 870 9 4412 708 33 1290 65 7",
    "==========\n----------\n##########\n..........  12\n~~~~~~~~~~",
    "copy copy copy copy copy COPY copy copy copy COPY COPY copy copy copy copy copy copy",
    "sludge rates pump ledger account sample lift permits gauge pools credit field terms wages capital blank meter",
    "• pompe, débitmètre, bassin\n• rente, dividende, prime\n• taux, crédit, dépôt\n• station, conduite, vanne",
    "boues (presse à boue)\nloyer (indice du logement)\nprime (compte de dividendes)\nbail (frais de déménagement)",
    "Zinsen\nLöhne\nMieten\nEinlagen\nRücklagen\nAbgaben\nGutschriften\nDurchfluss",
    "Probenehmer    412.7   88.1   3.5%\nHebewerk        90.2   14.0   n/a\nLeitzins         2.5%    2.5%  2.8%",
    "tipo oficial | letra del tesoro | margen\nenero 2020 | 311.2 | 8.1%\nfebrero 2020 | 298.4 | 7.9%",
    "bomba, caudal, lodo\ncrédito, renta, cuota\níndice, margen, tipo\nmuestra, planta, línea",
    "Norwick, annual levy (2012)\nSouthmere, joint credit (2015)\nEastholt, base cost (2020)\nWestgate, capital pool (2009)",
    "Rates were steady in the week to 4 May.\n\n4471;88.1;n/a;302;7.7%\n3190;12.0;5.5%;811;9.1%\n4402;90.7;n/a;117;2.2%\n7781;31.5;6.0%;640;8.8%\n9034;77.2;n/a;255;1.4%",
    "Policy Rate: wage gap / base cost\nTerm Repo: field blank / flow meter\nBase Cost: output gap / lift station",
    "ï¿½ï¿½Ã©â€™ï¿½ â•¬â•© Ã¢â‚¬ ï¿½ï¿½ â”€â”€ Ã‚Â½ï¿½",
    "* notes on the water fee and the lease of Eastholt\n* terms of the bond for a bank in Norwick\n* review of the rent index by the council of Southmere\n* list of the meters and the pumps in Westgate",
    "* notes sur le bail et la prime de Valmont\n* liste des pompes et du bassin de Clairval\n* examen de la rente pour le fonds à Beaumont\n* termes du prêt et de la taxe de Hautbois",
    "* Hinweise zu Miete und zu Pacht in Neudorf\n* Liste der Pumpen und der Becken um Altstadt\n* Prüfung der Rente für die Kasse in Waldheim",
    "* lista de la renta y del canon de Villanueva\n* notas sobre el pozo y la bomba en Montalto\n* examen del cupo para la caja de Rioseco",
    "2021-03-04 10:11:12 WARN fetch page=4 status=503\n2021-03-04 10:11:15 INFO retry page=4 status=200\n2021-03-04 10:12:01 INFO done rows=441",
    "[1] [2] [3] [4] [5] [6] [7] [8] [9] [10] [11] [12] [13] [14] [15] [16]",
)


def labelled() -> tuple[list[str], list[int]]:
    return [*PROSE, *JUNK], [1] * len(PROSE) + [0] * len(JUNK)
