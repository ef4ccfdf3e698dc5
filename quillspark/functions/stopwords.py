"""Word lists. Fixed values, the same in Spark and in the SQL that tests it."""

ENGLISH = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do"
    " does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me"
    " more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then"
    " there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)
#: Common given names, left out of cluster labels. Callers pass longer lists.
GIVEN_NAMES = tuple("james john robert michael william david mary patricia linda barbara elizabeth susan peter paul mark".split())
LABEL_EXTRA = ("com",)
