"""The word lists of caption features, strata, token categories and profiles."""

#: Caption features.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve".split()
ATTRIBUTE_WORDS = (
    "red blue green yellow black white brown gray grey orange pink purple large small big little young old tall short long "
    "wooden metal striped spotted colorful bright dark full empty open closed"
).split()
ACTION_WORDS = (
    "run running walk walking stand standing sit sitting hold holding eat eating drink drinking ride riding jump jumping play playing "
    "look looking wear wearing catch caught throw throwing fly flying swim swimming cut cutting sleep sleeping talk talking pose posing"
).split()
SPATIAL_WORDS = "left right above below under over behind front beside next near between inside outside on in at across through around".split()
OBJECT_WORDS = (
    "person people man woman boy girl child dog cat bird horse cow sheep elephant giraffe bear zebra car bus truck bicycle bike motorcycle "
    "train airplane boat skateboard ball bat racket chair table bed couch desk street road field grass beach ocean water kitchen room "
    "building tree sky flower food cake pizza phone umbrella bag bottle cup book tie"
).split()

#: Token categories of deletions. A car is " car" there, which no token equals.
TOKEN_OBJECTS = (
    "animal ball bird boat book cat chair child dog elephant food frisbee girl guitar horse man motorcycle person phone pizza plane sheep "
    "skateboard street table train tree umbrella vehicle water woman zebra"
).split()
TOKEN_ACTIONS = "biking climbing cutting driving eating flying holding jumping looking playing riding running sitting skating standing throwing walking wearing".split()
TOKEN_ATTRIBUTES = "big black blue brown colorful dark green large little long old red small tall white yellow young".split()
TOKEN_SPATIAL = "above across behind below beside between front inside near next on over under with".split()
TOKEN_STOPWORDS = "a an and at for in of on the to with".split()

#: Caption strata.
STRATA_STOPWORDS = "a an and are at by for from has in is it of on or that the their this to with".split()
STRATA_OBJECTS = (
    "animal ball bear bed bike bird boat book bottle bus car cat chair child dog elephant food frisbee girl guitar horse man motorcycle "
    "person phone pizza plane sheep skateboard street table train tree umbrella vehicle water woman zebra"
).split()
STRATA_NUMBERS = "one two three four five six seven eight nine ten".split()

#: Vocabulary statistics.
STOPWORDS = (
    "a an and are as at be been being by for from had has have he her hers him his i in is it its me my of on or our ours she that the "
    "their theirs them they this to was we were what when where which who will with you your yours"
).split()
