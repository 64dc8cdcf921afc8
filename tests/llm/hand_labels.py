"""Documents of the 0.1 tables, drawn over all shapes of text (mixtures, junk, prose in odd layouts, plain prose), read and
labelled by hand: whether running sentences make up more than half of the characters.  Never trained or calibrated on."""

PROSE = frozenset(
    map(
        int,
        """
    3 51 108 163 183 199 213 297 350 363 373 399 453 455 478 579 596 661 707 1112 1196 1229 1367 1370 1380 1403 1419 1478 1567 1641 1800 1805 1920 1937
    1981 1982 2027 2066 2086 2143 2192 2221 2379 2389 2401 2465 2490 2517 2608 2636 2697 2746 2804 2824 2841 2941 3084 3130 3237 3377 3382 3509 3560 3742
    3815 3832 3836 3951 3965 4047 4130 4140 4186 4219 4245 4275 4343 4399 4486 4532 4547 4760 4893 4912 4937 5022 5229 5326 5385 5505 5825 5847 5857 5903
    6069 6086 6196 6491 6548 6571 6731 6793 6868 6880 6908 6945 7115 7227 7237 7324 7347 7450 7707 7729 7737 7842 7905 8061 8247 8342 8559 8571 8573 8576
    8722 8773 8791 8926 9211 9394 9403 9412 9455 9669 9673 9954 9971
        """.split(),
    )
)
JUNK = frozenset(
    map(
        int,
        """
    4 197 198 333 437 915 923 961 1187 1272 1356 1364 1401 1430 1552 1743 1745 1959 1999 2661 2722 2819 2882 3036 3071 3310 3319 3427 3490 3516 3554 3566
    3570 3577 3663 3738 3802 3858 3891 4086 4124 4258 4299 4647 4663 4738 4821 5323 5399 5617 5820 5834 5867 5962 5993 6006 6103 6114 6209 6242 6344 6439
    6503 6774 6850 6909 7002 7040 7100 7174 7185 7421 7527 7586 7620 7689 7698 7771 7801 7856 7939 8008 8123 8138 8250 8271 8708 8738 8919 9032 9037 9055
    9241 9313 9316 9336 9533 9623 9680 9742 9872 9934
        """.split(),
    )
)
