"""The stack language word by word: scripts, and what they must print or leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.words import Machine
from gridloom.queries.base import query, table

STACK = {
    "1 2 nop dup . drop . ": "2 1 ",
    "1 2 over . . .": "1 2 1 ",
    "1 2 swap . .": "1 2 ",
    "1 2 3 rot . . .": "1 3 2 ",
    "1 2 3 -rot . . .": "2 1 3 ",
    "7 8 9 2 pick .": "7 ",
    "1 2 nip . depth .": "2 0 ",
    "0 ?dup depth . 5 ?dup depth .": "1 3 ",
    "1 2 2dup . . . .": "2 1 2 1 ",
    "1 2 3 4 2drop . .": "2 1 ",
    "1 2 3 4 2over . .": "2 1 ",
    "1 2 3 4 2swap . . . .": "2 1 4 3 ",
    "1 2 .s": "1 2 ",
    "1 2 3 abort depth .": "0 ",
}
ARITHMETIC = {
    "7 2 + . 7 2 - . 7 2 * . 7 2 / .": "9 5 14 3.5 ",
    "-7.9 2 mod . 7.5 2 fmod . 7 2 /mod . .": "-1 1.5 3.5 1 ",
    "7 3 2 */ . 7 3 2 */mod . .": "10.5 10 1 ",
    "12 10 and . 12 10 or . 12 10 xor . 5 invert .": "8 14 6 -6 ",
    "-16 2 rshift . 3 4 lshift .": "-4 48 ",
    "-3.5 abs . 3 negate . 3 4 max . 3 4 min .": "3.5 -3 4 3 ",
    "5 2* . 5 2/ . 5 1+ . 5 1- .": "10 2.5 6 4 ",
    "-2.7 f>s . -2.5 round . 2.5 round . 2.1 ceil . -2.1 floor .": "-2 -3 3 3 -3 ",
    "0 exp . 0 tanh . 0 sigmoid . 9 sqrt . 4 1/x . 1.5 sat . -1.5 relu .": "1 0 0.5 3 0.25 1 0 ",
    "1 ln . 100 log . 0 ln . 2 3 pow . 0 sin . 0 cos . pi .": "0 2 0 9 0 1 3.14159 ",
    "0 0= . 1 0= . -1 0< . 1 0> .": "-1 0 -1 -1 ",
    "1 1.0000001 = . 1 2 < . 1 2 > . 1 2 <> . 1 1 >= . 2 1 <= .": "-1 -1 0 -1 -1 0 ",
    "-1 1 u< . -1 1 u> .": "0 -1 ",
}
CONTROL = {
    ": a if 1 else 2 then . ; 1 a 0 a": "1 2 ",
    ": b begin dup . 1- dup 0= until drop ; 3 b": "3 2 1 ",
    ": c begin dup 0> while dup . 1- repeat drop ; 3 c": "3 2 1 ",
    ": d begin dup . 1- dup 0= if exit then again ; 2 d drop": "2 1 ",
    ": e for 42 emit next ; 3 e": "****",
    ": f 2 for aft r@ . then next ; f": "1 0 ",
    ": g 3 0 do i . loop ; g": "0 1 2 ",
    ": h 5 0 do i . i 1 = if leave then loop ; h": "0 1 ",
    ": j 4 >r 5 r@ . r> . . ; j": "4 4 5 ",
    ": k 7 ; immediate : l k ; .": "7 ",
    ": m 3 ; ' m exec .": "3 ",
    ": n 4 ; ' n is o o .": "4 ",
    ": p [ 1 2 + . ] 5 . ; p": "3 5 ",
}
MEMORY = {
    "variable a 5 a ! a @ . 2 a +! a ?": "5 7 ",
    "3 constant b b . 4 value c c . 9 to c c . : d 8 [to] c ; d c .": "3 4 9 8 ",
    "create e 5 , 6 , e 1 th @ . e 2 cells + here = .": "6 -1 ",
    "create f 3 allot 300 f c! f c@ .": "44 ",
    ": g create , does> @ 1 + ; 6 g h h .": "7 ",
    "variable q 9 q ! q 1 dump": "9\n",
    ": r 1 ; forget r depth .": "0 ",
}
CONSOLE = {
    "255 hex . decimal 255 . ": "ff 255 ",
    "bl emit 65 emit space 3 spaces cr": " A    \n",
    "42 5 .r 42 5 u.r -1 u.": "   42   424294967295 ",
    's" abc" type ." def" .( ghi)': "abcdefghi",
    "1 ( 2 ) . \\ 3 .": "1 ",
    '7 2.5 s" %d and %g%%" sprintf type': "7 and 2.5%",
    "base @ . $ff . %101 . #12 . &13 .": "10 255 5 12 13 ",
    "0 trace 0 ms flush depth .": "0 ",
    "1 . bye 2 .": "1 ",
}
TENSOR = {
    "3 vector{ 1 2 3 } sum . avg . max . min . norm 3 * f>s .": "6 2 3 1 11 ",
    "2 2 matrix{ { 1 2 } { 3 4 } } 2 2 matrix ones + sum . nip nip": "14 ",
    "2 2 matrix{ { 1 2 } { 3 4 } } 10 - sum . 10 swap - sum .": "-30 70 ",
    "2 2 matrix{ { 1 2 } { 3 4 } } dup *= sum . dup dup += sum .": "30 60 ",
    "2 2 matrix{ { 1 2 } { 3 4 } } dup -= sum . 1 + dup /= sum .": "0 4 ",
    "2 3 matrix{ { 1 2 3 } { 4 5 6 } } 3 2 matrix ones @ sum . drop @= sum .": "42 42 ",
    "2 3 matrix gradfill sum . zeros sum . 7 fill sum . std .": "2.5 0 42 0 ",
    "3 3 matrix eye sum . det . inverse sum . luinv sum .": "3 1 3 3 ",
    "2 2 matrix{ { 4 3 } { 6 3 } } plu sum f>s . drop sum . drop det .": "10 2 -6 ",
    "2 2 matrix{ { 1 2 } { 3 4 } } upper sum . drop lower sum .": "7 5 ",
    "2 3 matrix{ { 1 2 3 } { 4 5 6 } } transpose 1 t@ . nip dim sum .": "4 7 ",
    "2 3 matrix{ { 1 2 3 } { 4 5 6 } } 1 3 0 -1 slice sum . flatten 2 2 reshape2 3 t@ .": "16 6 ",
    "2 2 matrix{ { 1 2 } { 3 4 } } 0 9 t! sum . copy same_shape? .": "18 -1 ",
    "1 2 2 1 tensor ={ 1 2 3 4 } 1 1 1 5 reshape4": "ValueError",
    "4 vector zeros 1 ={ 5 6 } sum . 2 t@ . view nn.len .": "11 6 4 ",
    "2 vector{ 3 4 } 2 vector{ 1 2 } @ .": "11 ",
    "2 vector{ 1 1 } 2 2 matrix{ { 2 0 } { 0 4 } } solve sum .": "0.75 ",
    "2 2 matrix ones 2 2 matrix{ { 2 0 } { 0 4 } } matdiv sum .": "1.5 ",
    "2 3 2 2 matrix ones 2 2 matrix ones 2 2 matrix ones gemm sum .": "28 ",
    "2 2 matrix ones 2 2 matrix ones matmul sum .": "8 ",
    "2 vector{ -1 4 } abs sum . negate sum . relu sum .": "5 -5 0 ",
    "2 vector{ 0 0 } exp sum . drop 2 vector{ 0 0 } sigmoid sum . tanh sum 100 * round .": "2 1 92 ",
    "2 vector{ 4 9 } sqrt sum . 1/x sum 1000 * round . sat sum 1000 * round .": "5 833 833 ",
    "2 vector{ 1 1 } ln sum . drop 2 vector{ 10 10 } log sum . 2 pow sum .": "0 2 2 ",
    "2 vector{ 0 0 } sin sum . cos sum .": "0 2 ",
    "2 vector{ 1 3 } normalize sum . softmax sum . drop 2 vector{ 0 0 } logsoftmax exp sum .": "0 1 1 ",
    "50 50 matrix rand max 1 <= . min 0 > . randn avg abs 0.1 < .": "-1 -1 -1 ",
    "3 2 matrix ones 2 3 matrix ones +": "ValueError",
    "2 1 2 1 tensor ones 1 1 2 1 tensor ={ 1 2 } + sum .": "10 ",
    "2 3 vector{ 1 2 3 } .": "vector[3] = {+1.0000 +2.0000 +3.0000}\n",
}
NETWORK = {
    "2 4 4 1 nn.model 0.1 2 conv2d relu 2 maxpool flatten 3 linear softmax nn.len . batchsize .": "6 2 ",
    "1 4 4 1 nn.model 0.1 2 conv1x1 tanh 2 avgpool selu 2 minpool elu network": "0 input [1,4,4,1] 0\n1 conv2d [1,4,4,2] 4\n2 tanh [1,4,4,2] 0\n3 avgpool [1,2,2,2] 0\n4 selu [1,2,2,2] 0\n5 minpool [1,1,1,2] 0\n6 elu [1,1,1,2] 0\n",
    "1 2 2 1 nn.model 0.1 1 dconv2d leakyrelu 2 upsample batchnorm 0.5 dropout sigmoid n@": "IndexError",
    "1 1 2 1 nn.model 0 1 linear 2 vector{ 3 4 } 1 nn.w= 1 vector{ 5 } 1 nn.b= 1 1 2 1 tensor ={ 1 2 } forward -1 n@ sum . drop 1 nn.w sum . drop 1 nn.b sum . drop 1 nn.ex sum .": "16 7 5 3 ",
    "1 1 2 1 nn.model 0 2 linear softmax 1 1 2 1 tensor ones forward 1 1 2 1 tensor ={ 1 0 } nn.onehot= backprop 1 nn.db sum abs 0.001 < . drop 1 nn.dw sum abs 0.001 < .": "-1 -1 ",
    "1 1 2 1 tensor ={ 0.5 0.5 } 1 1 2 1 tensor ={ 1 0 } loss.mse . 1 1 2 1 tensor ={ 1 0 } loss.ce 1000 * round . 1 1 2 1 tensor ={ 1 0 } loss.bce 1000 * round . 1 1 2 1 tensor ={ 1 0 } loss.nll .": "0.5 693 1386 -0.5 ",
    "1 1 2 1 nn.model 0 2 linear softmax 1 1 2 1 tensor ones forward 1 1 2 1 tensor ={ 1 0 } nn.onehot= nn.onehot sum . drop nn.hit 2 < . nn.loss 0 > . 0.1 nn.adam 0.1 nn.adamw 0.1 nn.sgd 1 nn.max_norm nn.zero 0 trainable predict nn.len .": "1 -1 -1 2 ",
    "3 1 2 1 nn.model flatten 3 vector{ 1 0 1 } broadcast nn.onehot sum .": "4 ",
    "1 1 2 1 nn.model 2 vector{ 1 2 } >n nn.len .": "1 ",
}


def _values(cases: dict[str, str]) -> str:
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    return "SELECT CAST(i AS INTEGER) AS i, printed FROM (VALUES " + ", ".join(f"({i}, {text(v)})" for i, v in enumerate(cases.values())) + ") t(i, printed)"


def _run(spark: SparkSession, cases: dict[str, str]) -> DataFrame:
    rows = []
    for i, script in enumerate(cases):
        try:
            printed = Machine(spark).run(script)
        except (ValueError, IndexError, TypeError, AttributeError, KeyError) as e:
            printed = type(e).__name__
        rows.append((i, printed))
    return spark.createDataFrame(rows, "i int, printed string")


for _name, _cases in {"stack": STACK, "arithmetic": ARITHMETIC, "control": CONTROL, "memory": MEMORY, "console": CONSOLE, "tensor": TENSOR, "network": NETWORK}.items():

    @query(f"words_{_name}", _values(_cases))
    def _words(spark: SparkSession, d: str, cases: dict[str, str] = _cases) -> DataFrame:
        return _run(spark, cases)


@query("words_dataset", "SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS samples FROM (SELECT vec_id // 128 AS b, count(*) AS n FROM embeddings GROUP BY 1)")
def words_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A loop over the mini-batches of the embeddings, counted by the script itself."""
    from gridloom.sources import corpora

    def reader(s: SparkSession) -> DataFrame:
        x = F.col("embedding").cast("array<double>").alias("x")
        return table(s, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", x, F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("c"))

    corpora.register("embeddings", reader)
    m = Machine(spark)
    m.run("variable batches variable samples : count 1 batches +! ; 128 dataset embeddings")
    m.run(": loop for count next ; loop batches @ 128 dataset embeddings nn.len nip")
    batches, samples = m.ss[-2:]
    return spark.createDataFrame([(int(batches), int(samples))], "batches bigint, samples bigint")
