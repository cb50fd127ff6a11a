"""Lancaster (Paice and Husk) stemmer."""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

# The rule list, in order.  Each rule is suffix,replacement,flag
# with ? for nothing.
RULES = """
ia,?,intact;a,?,intact;bb,b,stop;ytic,ys,stop;ic,?,continue;nc,nt,continue;dd,d,stop;ied,y,continue;
ceed,cess,stop;eed,ee,stop;ed,?,continue;hood,?,continue;e,?,continue;lief,liev,stop;if,?,continue;
ing,?,continue;iag,y,stop;ag,?,continue;gg,g,stop;th,?,intact;guish,ct,stop;ish,?,continue;i,?,intact;
i,y,continue;ij,id,stop;fuj,fus,stop;uj,ud,stop;oj,od,stop;hej,her,stop;verj,vert,stop;misj,mit,stop;
nj,nd,stop;j,s,stop;ifiabl,?,stop;iabl,y,stop;abl,?,continue;ibl,?,stop;bil,bl,continue;cl,c,stop;
iful,y,stop;ful,?,continue;ul,?,stop;ial,?,continue;ual,?,continue;al,?,continue;ll,l,stop;ium,?,stop;
um,?,intact;ism,?,continue;mm,m,stop;sion,j,continue;xion,ct,stop;ion,?,continue;ian,?,continue;
an,?,continue;een,?,protect;en,?,continue;nn,n,stop;ship,?,continue;pp,p,stop;er,?,continue;ear,?,protect;
ar,?,stop;or,?,continue;ur,?,continue;rr,r,stop;tr,t,continue;ier,y,continue;ies,y,continue;sis,s,stop;
is,?,continue;ness,?,continue;ss,?,protect;ous,?,continue;us,?,intact;s,?,contint;s,?,stop;plicat,ply,stop;
at,?,continue;ment,?,continue;ent,?,continue;ant,?,continue;ript,rib,stop;orpt,orb,stop;duct,duc,stop;
sumpt,sum,stop;cept,ceiv,stop;olut,olv,stop;sist,?,protect;ist,?,continue;tt,t,stop;iqu,?,stop;ogu,og,stop;
siv,j,continue;eiv,?,protect;iv,?,continue;bly,bl,continue;ily,y,continue;ply,?,protect;ly,?,continue;
ogy,og,stop;phy,ph,stop;omy,om,stop;opy,op,stop;ity,?,continue;ety,?,continue;lty,l,stop;istry,?,stop;
ary,?,continue;ory,?,continue;ify,?,stop;ncy,nt,continue;acy,?,continue;iz,?,continue;yz,ys,stop;
"""
DESCRIPTION = "lancaster"


class Rule(NamedTuple):
    rule_id: int
    suffix: str
    repl: str
    intact: bool  # only for a word that no rule has changed yet
    cont: bool  # go on with the result
    prot: bool  # leave the word alone


def parse(text: str) -> list[Rule]:
    rules = []
    for entry in "".join(text.split()).strip(";").split(";"):
        suffix, repl, flag = entry.split(",")
        rules.append(Rule(len(rules) + 1, suffix, repl.replace("?", ""), flag in ("intact", "contint", "protint"), flag in ("continue", "contint"), flag in ("protect", "protint")))
    return rules


ALL = parse(RULES)
_ENDING = defaultdict(list)
for _rule in ALL:
    _ENDING[_rule.suffix[-1]].append(_rule)


def acceptable(word: str) -> bool:
    if len(word) > 3:
        return True
    if word[:1] in set("aeiouy"):
        return len(word) >= 2 and word[1] in set("bcdfghjklmnpqrstvwxz")
    return len(word) == 3 and word[1] in set("aeiouy")


def stem_with_rule(word: str) -> tuple[str, int]:
    """The stem, and the last rule that matched (0: none)."""
    if not acceptable(word):
        return word, 0
    intact, used = True, 0
    while True:
        rule = next((r for r in _ENDING.get(word[-1], ()) if (intact or not r.intact) and len(r.suffix) < len(word) and word.endswith(r.suffix)), None)
        if rule is None:
            return word, used
        used = rule.rule_id
        if rule.prot:
            return word, used
        shorter = word[: len(word) - len(rule.suffix)] + rule.repl
        if not rule.cont:
            return shorter, used
        if not acceptable(shorter):
            return word, used
        word, intact = shorter, False


def stem(word: str) -> str:
    return stem_with_rule(word)[0]
