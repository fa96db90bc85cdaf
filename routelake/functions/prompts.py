"""Prompt builders (T9), task descriptions, option rendering (T8) as Columns.

Templates are rendered with ``concat`` of literal pieces and columns, so a
prompt is built inside the JVM for every row.  Indentation and blank lines
are part of the prompt text.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

THINK = "Let's think step by step."

# Prompt templates, as text with {placeholders}; key (name, think).
TEMPLATES = {
    ("qa", False): (" Use the following context to answer the question.\n"
                    "        ## Context:\n        {context}\n\n        ## Question:\n        {query}\n        "),
    ("qa", True): (" Use the following context to answer the question.\n"
                   "        ## Context:\n        {context}\n\n        ## Question:\n        {query}\n        \n"
                   "Let's think step by step.\n        "),
    ("bool", False): (" Use the following context to answer the question. Your answer must be True or False.\n"
                      "                ## Context:\n                {context}\n\n"
                      "                ## Question:\n                {query}\n                "),
    ("bool", True): (" Use the following context to answer the question. Your answer must be True or False.\n"
                     "                        ## Context:\n                        {context}\n\n"
                     "                        ## Question:\n                        {query}\n                        \n"
                     "Let's think step by step.\n                        "),
    ("mc", False): ("Answer the following multiple-choice question by selecting the correct option (A, B, C, or D). "
                    "You Must put your final answer letter in a parenthesis.\n\n## Question:\n{question}\n\n"
                    "## Options:\n{options}\n"),
    ("gsm8k", False): "\n        Answer the following question.\n\n        Question: {query}\n        ",
    ("gsm8k", True): "\n        Answer the following question.\n\n        Question: {query}\n        Let's think step by step\n        ",
    ("math", False): ("\n        Answer the following question. Make sure to put the answer ( and only answer ) inside "
                      "\\boxed{{}}.\n\n        Question: {query}\n        "),
    ("math", True): ("\n        Answer the following question. Make sure to put the answer ( and only answer ) inside "
                     "\\boxed{{}}.\n\n        Question: {query}\n        Let's think step by step\n        "),
    ("choice", False): ("\n        Answer the following multiple-choice question by selecting the correct option. "
                        "You Must put your final answer letter in a parenthesis.\n\n        Question: {query} \n\n"
                        "        {options}"),
    ("choice", True): ("\n        Answer the following multiple-choice question by selecting the correct option. "
                       "You Must put your final answer letter in a parenthesis.\n\n        Question: {query} \n\n"
                       "        {options}\n\nLet's think step by step"),
    ("hellaswag", False): ("\n        Context: {query} \n\n\n        Which of the following is the most likely continuation? "
                           "You Must put your final answer letter in a parenthesis.\n        {options}"),
    ("hellaswag", True): ("\n        Context: {query} \n\n\n        Which of the following is the most likely continuation? "
                          "You Must put your final answer letter in a parenthesis.\n        {options}\n\nLet's think step by step"),
    ("mbpp", False): ("You are an expert Python programmer, and here is your task: {text} Your code should pass these "
                      "tests:\n\n{tests}\n Implement the function (no irrelevant words or comments) in this format: "
                      "[BEGIN] <Your Code> [Done]\n"),
    ("mbpp", True): ("You are an expert Python programmer, and here is your task: {text} Your code should pass these "
                     "tests:\n\n{tests}\n Implement the function (no irrelevant words or comments) in this format: "
                     "[BEGIN] <Your Code> [Done]\n \n  Let's think step by step."),
    ("humaneval", False): ("You are an expert Python programmer. Complete the following function:\n\n"
                           "                {prompt}\n\n                Implement the function body only. Do not repeat the "
                           "function signature or docstring.\n                Put the code in this format: [BEGIN] "
                           "<Your Code - function body only> [Done]\n                "),
    ("humaneval", True): ("You are an expert Python programmer. Complete the following function:\n\n"
                          "                {prompt}\n\n                Implement the function body only. Do not repeat the "
                          "function signature or docstring.\n                Put the code in this format: [BEGIN] "
                          "<Your Code - function body only> [Done]\n\n Let's think step by step.\n                "),
}

# Task descriptions (14 tasks).
TASK_DESCRIPTIONS = {
    "natural_qa": "Natural Questions consists of real Google search queries paired with full Wikipedia articles. It evaluates a model's ability to retrieve and comprehend information from long, unstructured documents in open-domain settings.",
    "trivia_qa": "TriviaQA features complex trivia-style questions with evidence from multiple web sources. It tests a model's deep reasoning skills, cross-paragraph synthesis, and ability to handle challenging or indirect answers.",
    "squad": "SQuAD provides questions based on short Wikipedia passages where the answer is explicitly found in the text. It measures sentence-level comprehension and the model's precision in extracting factual information from concise contexts.",
    "boolq": "BoolQ contains yes/no questions based on a given paragraph, written in natural language. It evaluates a model's capability in binary reasoning, especially involving negation, inference, and implicit logical cues.",
    "gsm8k": "GSM8K is a benchmark of grade school math word problems designed to evaluate a model's numerical reasoning, problem-solving skills, and ability to generate step-by-step solutions using arithmetic and logical reasoning.",
    "commonsense_qa": "CommonsenseQA is a multiple-choice question dataset that requires models to apply commonsense knowledge beyond factual recall. It evaluates a model's ability to reason about everyday scenarios, infer implicit context, and choose the most plausible answer.",
    "mmlu": "MMLU (Massive Multitask Language Understanding) covers 57 subjects ranging from STEM to humanities, evaluating a model's breadth of knowledge and ability to apply concepts across multiple domains with varying complexity.",
    "gpqa": "GPQA evaluates a model's ability to answer challenging graduate-level multiple-choice questions spanning physics, chemistry, biology, and other scientific fields.",
    "mbpp": "MBPP (Mostly Basic Python Programming) features Python programming tasks of varying complexity with test cases, measuring a model's ability to generate syntactically correct and functionally accurate Python code.",
    "human_eval": "HumanEval is a challenging programming benchmark that evaluates a model's ability to both understand problem descriptions and generate code that implements the required functionality correctly.",
    "math": "MATH is a dataset of high school and competition-level mathematics problems, requiring detailed multi-step solutions across algebra, geometry, calculus, and more. It evaluates a model\u2019s symbolic reasoning ability, problem-solving depth, and proficiency in generating mathematically rigorous derivations.",
    "arc_challenge": "ARC-Challenge is a benchmark of difficult grade-school science questions requiring complex reasoning, knowledge retrieval, and elimination strategies. It tests a model\u2019s ability to integrate scientific understanding with problem-solving skills in a multiple-choice setting.",
    "hellaswag": "HellaSwag is a challenging commonsense reasoning benchmark featuring sentence completion tasks with deceptively similar distractors. It evaluates a model\u2019s ability to infer plausible continuations, grasp everyday physical and social scenarios, and distinguish subtle contextual cues.",
    "openbook_qa": "OpenbookQA consists of elementary science questions that require combining core scientific facts with broad commonsense knowledge. It evaluates a model\u2019s ability to perform open-book reasoning, make connections across domains, and apply learned facts in novel contexts.",
}


def render(template: str, **cols) -> Column:
    """Fill ``{name}`` placeholders of a template with columns (``{{``/``}}`` are literal braces)."""
    parts = []
    for literal, field, _spec, _conv in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            v = cols[field]
            parts.append(v if isinstance(v, Column) else F.col(v))
    return F.concat(*parts) if parts else F.lit("")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def qa_prompt(context, query, think: bool = False) -> Column:
    return render(TEMPLATES[("qa", think)], context=_c(context), query=_c(query))


def bool_prompt(context, query, think: bool = False) -> Column:
    return render(TEMPLATES[("bool", think)], context=_c(context), query=_c(query))


def mc_options(choices) -> Column:
    """``A. x\\n`` per option (labels A-D by position)."""
    return F.array_join(F.transform(_c(choices), lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), x, F.lit("\n"))), "")


def mc_prompt(question, choices) -> Column:
    return render(TEMPLATES[("mc", False)], question=_c(question), options=mc_options(choices))


def gsm8k_prompt(query, think: bool = False) -> Column:
    return render(TEMPLATES[("gsm8k", think)], query=_c(query))


def math_prompt(query, think: bool = False) -> Column:
    return render(TEMPLATES[("math", think)], query=_c(query))


def labelled_options(labels, texts) -> Column:
    """``\\n(L) text`` per option."""
    return F.array_join(F.zip_with(_c(labels), _c(texts), lambda lab, t: F.concat(F.lit("\n("), lab, F.lit(") "), t)), "")


def choice_prompt(query, labels, texts, think: bool = False) -> Column:
    return render(TEMPLATES[("choice", think)], query=_c(query), options=labelled_options(labels, texts))


def hellaswag_prompt(query, labels, texts, think: bool = False) -> Column:
    return render(TEMPLATES[("hellaswag", think)], query=_c(query), options=labelled_options(labels, texts))


def mbpp_prompt(text, tests, think: bool = False) -> Column:
    return render(TEMPLATES[("mbpp", think)], text=_c(text), tests=F.array_join(_c(tests), "\n"))


def humaneval_prompt(prompt, think: bool = False) -> Column:
    return render(TEMPLATES[("humaneval", think)], prompt=_c(prompt))


def task_description(task) -> Column:
    """Task name -> description (a 14-entry literal map)."""
    m = F.create_map(*[x for k, v in TASK_DESCRIPTIONS.items() for x in (F.lit(k), F.lit(v))])
    return m[_c(task)]
